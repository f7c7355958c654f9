"""Clean-up steps applied to extracted strings."""

from __future__ import annotations

import logging

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import Modifier, java_regex, may_match_empty
from .arrays import let
from .dates import iso_date

log = logging.getLogger(__name__)


def regex_modifier(c: Column, patterns: list[str], returns: str = "original") -> Column:
    """Keep the string, or its first match, if any pattern is found; else null.

    Patterns are tried in order.  A pattern that is not valid is skipped.
    """
    tries: list[Column] = []
    for p in patterns:
        java = java_regex(p)
        if java is None:
            log.warning("skipping invalid pattern %r", p)
        elif returns == "original":
            tries.append(F.when(c.rlike(java), c))
        else:
            tries.append(F.regexp_substr(c, F.lit(java)))
            if may_match_empty(p):
                # regexp_substr cannot tell an empty match from none
                tries.append(F.when(c.rlike(java), F.lit("")))
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def apply_modifiers(c: Column, modifiers: tuple[Modifier, ...], as_of: Column | None) -> Column:
    """The chain, left to right; null stops it."""
    for m in modifiers:
        c = let(c, _step(m, as_of))
    return c


def _step(m: Modifier, as_of: Column | None):
    if m.type == "regex":
        return lambda x: regex_modifier(x, list(m.regex), m.returns)
    return lambda x: iso_date(x, as_of)
