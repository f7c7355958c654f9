import random

import pyarrow as pa
from cases import lower, words

from pagequarry.llm.words import each_slice


def test_words_and_shingles_by_hash():
    rng = random.Random(1)
    texts = [None, "", " \n", "a", "Ab c", "x y z w v", "x y z w v u", " lead  trail "]
    texts += ["".join(rng.choice(["a", "B", "é", "\x0b", "\t", "\n ", " ", "cc"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    seen: dict = {}
    for lo, hi, w in each_slice(pa.array(texts)):
        hashes, begins = w.shingles()
        for r in range(lo, hi):
            own = words(lower(texts[r]))
            got = w.hashes[w.first[r - lo] : w.first[r - lo + 1]]
            assert len(got) == len(own)
            parts = [tuple(own[i : i + 5]) for i in range(len(own) - 4)] if len(own) > 4 else [tuple(own)] * bool(own)
            mine = hashes[begins[r - lo] : begins[r - lo + 1]]
            assert len(mine) == len(parts)
            for what, h in [*zip(own, got), *zip(parts, mine)]:
                assert seen.setdefault(what, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns():
    column = pa.array(["a b", None, "c", "d e f"]).slice(1)
    assert [w.counts().tolist() for _, _, w in each_slice(column)] == [[0, 1, 3]]
