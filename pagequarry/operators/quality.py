"""Checking many specs at once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.spec import check_spec


def broken_rules(specs: DataFrame, key: str, text: str) -> DataFrame:
    """One row ``(key, rule, place, message)`` per broken rule of each JSON spec.

    The rules are the ones a spec is built with; a row is checked on its own, so
    nothing is shuffled.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, raw in zip(batch[key], batch[text]):
                try:
                    found = [(e.rule, e.where, str(e)) for e in check_spec(json.loads(raw))[1]]
                except (TypeError, json.JSONDecodeError) as e:
                    found = [("json", "spec", str(e))]
                rows += [(k, *f) for f in found]
            yield pd.DataFrame(rows, columns=[key, "rule", "place", "message"])

    kind = specs.schema[key].dataType.simpleString()
    out = f"{key} {kind}, rule string, place string, message string"
    return specs.select(key, text).mapInPandas(check, out)
