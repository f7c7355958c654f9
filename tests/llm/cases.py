"""Awkward documents, and plain re-statements of the operators to compare with."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = (
    "rep comp kept size row key src bucket member n mix words _words _row _score _taken _gone_id fp doc at sample id"
    " target epochs part unit text_ _mix_src _size _copies quality count word"
).split()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, width: int = 5) -> set:
    w = words(lower(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n))


def awkward() -> list[tuple]:
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split(" ")
    near[50] = "changed"
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, " ".join(near), "en", "b", 1),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n\x0b\f\r ", "en", None, 7),
        (7, "one two three", "de", "a", 3),
        (8, "One two THREE", "de", "c", 3),
        (9, prose(rng, 30_000), "en", "a", None),
        (None, base, "en", "a", 1),
        (None, "x", None, "", 1),
        (10, "same " * 300, "en", "b", 2),
        (11, prose(rng, 80), "en", "c", 2),
        (11, prose(rng, 90), "en", "c", 2),
        (12, base, "en", "a", 1),
        (12, base, "en", "a", 1),
        (-5, "É ß 😀 \x00 nul", "fr", "é", 3),
    ]
    rows += [(100 + i, prose(rng, 60) + " " + base if i % 3 == 0 else prose(rng, 200), "en", "abc"[i % 3], 9) for i in range(20)]
    return rows


def with_clashes(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
