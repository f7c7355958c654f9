"""Source divergence, fill-in-the-middle and the n-gram Jaccard join, against plain re-statements."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import DOCS, prose, shingles

from pagequarry.llm import divergence, fim, jaccard
from pagequarry.llm.divergence import Band, Tally, _counted, audit, pieces, skyband, term_spans
from pagequarry.llm.fim import ExceptionIndex, fill_in_middle, restored
from pagequarry.llm.jaccard import LEAST_PERCENT, jaccard_components, most_differing, signatures, size_bands

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")

# ---------------------------------------------------------------- source divergence


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_audit(rows, least_docs, ranks):
    rows = [(lang or "", source or "", terms(text)) for _, text, lang, source, *_ in rows]
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), {(lang, source) for lang, source, _ in rows}
    for lang, source, found in rows:
        in_docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]
        own = {s: [counts[lang, s][t] for t in kept] for g, s in groups if g == lang}
        share = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        p = {s: share(c) for s, c in own.items()}
        q = share([sum(c) for c in zip(*own.values())])
        for s in own:
            pairs = [(sum(abs(x - y) for x, y in zip(p[s], p[o])), o) for o in own if o != s]
            told = [(x - y, t) for x, y, t, c in zip(p[s], q, kept, own[s]) if c and x > y]
            for part, found, most in (("pair", pairs, None), ("term", told, ranks)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def spread_words(rng, n):
    return " ".join(rng.choice(("Äpfel", "über", "it's", "x1y", "日本", "the", "zz")) + rng.choice("ab-_") + rng.choice("cdE") for _ in range(n))


def test_tally_gives_everything_out(rows):
    """Whatever is gathered before it is given out."""
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] or "" for r in rows], pa.string()) for i in (2, 3, 1)], names=["lang", "source", "text"])
    for most in (3, 100, 1 << 20):
        got, docs = Counter(), Counter()
        for part in _counted(iter([batch, batch.slice(0, 0), batch]), Tally(most)):
            for r in part.to_pylist():
                got[r["lang"], r["source"], r["term"]] += r["g"]
                docs[r["lang"], r["source"], r["term"]] += r["docs"]
        want, in_docs = Counter(), Counter()
        for _, text, lang, source, *_ in rows + rows:
            want.update((lang or "", source or "", t) for t in terms(text))
            in_docs.update((lang or "", source or "", t) for t in set(terms(text)))
        assert got == want and docs == in_docs


@pytest.mark.parametrize("least_docs,ranks,cells", [(2, 3, 1 << 18), (1, 1, 4), (40, 50, 1 << 18)])
def test_audit_against_plain_counts(spark, docs, rows, monkeypatch, least_docs, ranks, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    got = sorted(tuple(r) for r in audit(docs, least_docs, ranks).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, least_docs, ranks)


def test_audit_of_many_sources(spark):
    rng = random.Random(8)
    rows = [(i, spread_words(rng, rng.randint(0, 40)), rng.choice(["a", "b", None]), f"s{rng.randint(0, 30)}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in audit(df, 3, 5).collect()) == plain_audit(rows, 3, 5)
    assert audit(df.limit(0)).collect() == []


def test_dominated_terms_go(spark):
    rng = random.Random(2)
    rows = [("l", f"s{i % 2}", f"t{i:04}é", rng.randint(1, 30), rng.randint(30, 90)) for i in range(1500)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, g long, c long").repartition(5)
    want = set()
    for s in ("s0", "s1"):
        own = sorted((r for r in rows if r[1] == s), key=lambda r: r[2].encode())
        want |= {r for i, r in enumerate(own) if sum(o[3] >= r[3] and o[4] <= r[4] for o in own[:i]) < 4}
    assert {tuple(r) for r in skyband(df, 4).collect()} == want
    band = Band(1)
    assert list(band.keep(np.array([5, 5, 6, 1]), np.array([9, 9, 9, 8]))) == [True, False, True, True]


def test_long_texts_are_cut_between_terms():
    data = np.frombuffer(("ab " * 9 + "c" * 40 + " de").encode(), np.uint8)
    parts = list(pieces(data, 7))
    assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    found = [data[lo:hi][b:e].tobytes() for lo, hi in parts for b, e in zip(*term_spans(data[lo:hi], np.array([0, hi - lo]))[:2])]
    assert found == data.tobytes().split()


# ---------------------------------------------------------------- fill in the middle


def plain_cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(text), "plain", None, None, text)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (doc_id, len(text), "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, len(text), "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_cuts_against_strings(spark, docs, rows, no_docs):
    rng = random.Random(5)
    more = [(1000 + i, "".join(rng.choice("aé日😀<PSM> \n") for _ in range(rng.randint(0, 30))), None, None, None) for i in range(400)]
    more += [(2000, "a<P>b", None, None, None), (2001, "<S", None, None, None), (2002, "P>", None, None, None), (2003, "<" * 50, None, None, None)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, DOCS).select("doc_id", "text"))
    got = restored(fill_in_middle(df)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    want = sorted((plain_cut(*r[:2]) for r in rows + more), key=order)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=order) == want
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1] or "") for r in rows + more)
    for r in got:
        if r.form != "plain":
            assert r.prefix_bytes == len(r.text[: r.prefix_chars].encode())
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(no_docs).collect() == []


def test_exception_index():
    text = "aé" * 3 + "日x😀" + "b" * 50
    index = ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    assert len(index.at_byte) == 5
    points = np.arange(len(text) + 1)
    want = np.array([len(text[:k].encode()) for k in points])
    assert (index.bytes(points) == want).all() and (index.points(want) == points).all()
    plain = ExceptionIndex(np.frombuffer(b"x" * 1000, np.uint8))
    assert plain.excess.nbytes == 8 and plain.bytes(np.array([999]))[0] == 999
    assert fim.draws([None, 5]).shape == (2, 4)


# ---------------------------------------------------------------- n-gram Jaccard join


def plain_components(rows, width=4, percent=LEAST_PERCENT):
    sets = [shingles(t, width) for _, t, *_ in rows]
    parent = {d: d for d, *_ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                lo, hi = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[hi] = lo
    return sorted(((d, len(s), None if d is None else root(d)) for (d, *_), s in zip(rows, sets)), key=str)


def joined(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, **kw).collect()), key=str)


def edited(rng, text, times):
    words = text.split(" ")
    for _ in range(times):
        k = rng.randrange(len(words))
        words[k : k + rng.randint(0, 1)] = [f"n{rng.randint(0, 9)}"] * rng.randint(0, 2)
    return " ".join(words)


def crowd(seed, n=150):
    """Chains of edits around the threshold, odd members, a group of near copies, short texts."""
    rng = random.Random(seed)
    bases = [prose(rng, rng.choice([3, 5, 8, 13, 20, 33, 60, 120, 300])) for _ in range(12)]
    rows = []
    for i in range(n):
        text = rng.choice(bases)
        long = len(text.split(" ")) // 40
        rows.append((i, edited(rng, text, rng.choice([0, 1, 1, 2, 2 + long, 4 + 2 * long])), "en", "a", 1))
    return rows


def test_join_against_all_pairs(docs, rows, no_docs):
    assert joined(docs) == plain_components(rows)
    assert joined(no_docs) == []


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"HUBS": 1, "BLOCK_SETS": 2, "BLOCK_SHINGLES": 300, "HUB_MEMBERS": 2, "PLACES_TO_SEND": 0}), (3, {"HUBS": 3, "COPIES": 0, "BLOCK_SETS": 3})])
def test_join_of_crowds(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = crowd(seed)
    assert joined(spark.createDataFrame(rows, DOCS).repartition(3)) == plain_components(rows)


def test_join_at_other_limits(spark):
    rows = crowd(4, 80)
    assert joined(spark.createDataFrame(rows, DOCS), width=2, percent=60) == plain_components(rows, 2, 60)


@pytest.mark.parametrize("size", [6, 7, 11, 12, 19, 30, 64, 150, 700, 3000])
def test_linked_sets_share_a_signature(size):
    """Of sets that differ in as much as they may, also unevenly, each pair shares a signature."""
    rng = np.random.default_rng(size)
    new = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    for _ in range(60):
        one = new(size)
        gone = int(rng.integers(0, most_differing(size, size) + 1))
        other = np.concatenate((one[gone:], new(int(rng.integers(0, gone + 2)))))
        common = size - gone
        if 100 * common < LEAST_PERCENT * (size + len(other) - common):
            continue
        found, begins = signatures(np.concatenate((np.sort(one), np.sort(other))), np.array([0, size, size + len(other)]))
        if gone or len(other) > size:
            assert set(found[: begins[1]]) & set(found[begins[1] :]), (size, gone, len(other))


def test_bands_hold_every_link():
    bands = size_bands(5000)
    for a in range(6, 4000):
        b = a * 100 // LEAST_PERCENT
        assert any(x.lo <= a and b <= x.hi for x in bands), a
