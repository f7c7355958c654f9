"""Operators on documents: awkward rows, empty tables, and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import DOCS, lower, shingles, words
from pyspark.sql import functions as F

from pagequarry.llm import hmm, neardup, repeats
from pagequarry.llm.decontam import contaminated, decontaminated
from pagequarry.llm.licenses import _PLAIN, TEMPLATES, Passages, Templates, scan_licenses
from pagequarry.llm.mixing import mix, mixed_documents, n_words
from pagequarry.llm.neardup import near_duplicates, without_near_duplicates
from pagequarry.llm.quality import BUCKETS, SMOOTHING, THRESHOLD, good_documents, quality
from pagequarry.llm.repeats import LENGTH, without_repeats
from pagequarry.llm.suffixes import Prefixes, permuted_common_prefixes, suffix_array
from pagequarry.llm.tokens import EliasFano, Encoder, tokenized
from pagequarry.llm.words import utf8

LABELS = "doc_id long, quality int, toxic int, text string, kept int"


def labels(spark, ids):
    return spark.createDataFrame([(i, 1, 0, "t", 1) for i in ids] + [(None, None, None, None, None), (10, 0, 0, "", 0)], LABELS)


# ---------------------------------------------------------------- quality rules


def base_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def n_gram_buckets(text):
    import xxhash

    def h(x, seed=42):
        return xxhash.xxh64(x.encode(), seed=seed).intdigest()

    w = words(text)
    return [h(x) % BUCKETS if h(x) < 2**63 else (h(x) - 2**64) % BUCKETS for x in w] + [
        (lambda v: (v if v < 2**63 else v - 2**64) % BUCKETS)(h(b, h(a))) for a, b in zip(w, w[1:])
    ]


def test_quality_against_brute_force(spark, docs, rows):
    trusted = {1, 7, 9, 11, 103}
    got = quality(docs, labels(spark, trusted)).collect()
    assert len(got) == len(rows)
    raw, good = Counter(), Counter()
    for doc_id, text, *_ in rows:
        raw.update(n_gram_buckets(text))
        if doc_id in trusted:
            good.update(n_gram_buckets(text))

    def share(counts, b):
        return math.log((counts[b] + SMOOTHING) / (sum(counts.values()) + SMOOTHING * BUCKETS))

    want = []
    for doc_id, text, *_ in rows:
        counts = base_counts(text)
        grams = n_gram_buckets(text)
        score = sum(share(good, b) - share(raw, b) for b in grams[:400]) if len(grams) <= 400 else None
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want.append((doc_id, *counts, failed, score / len(grams) if grams and score is not None else None))
    order = lambda r: (r[0] is None, r[0] or 0, r[1:6])
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        assert tuple(g)[:7] == w[:7]
        if w[7] is not None:
            assert g.score == pytest.approx(w[7], abs=1e-4)
        assert g.kept == (not g.base_failed and g.score >= THRESHOLD)


def test_quality_without_labels_or_rows(spark, docs, no_docs):
    none = labels(spark, []).limit(0)
    assert all(r.score == 0 and r.kept != r.base_failed for r in quality(docs, none).collect())
    assert quality(no_docs, none).collect() == []
    kept = good_documents(docs, none)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 9}
    assert good_documents(no_docs, none).collect() == []


# ---------------------------------------------------------------- near duplicates


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = {d: d for d, *_ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                lo, hi = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[hi] = lo
    return [(d, len(s), None if d is None else root(d)) for (d, *_), s in zip(rows, sets)]


def test_near_duplicates_against_brute_force(docs, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)


@pytest.mark.parametrize("sets_in_block", [1024, 7])
def test_chain_of_near_copies_in_one_bucket(spark, monkeypatch, sets_in_block):
    monkeypatch.setattr(neardup, "BLOCK_SETS", sets_in_block)
    # each is linked with its neighbours only, so the hub of a bucket reaches few of them
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 12 : i * 12 + 120])) for i in range(20)]
    rows += [(100 + i, " ".join(w[:100] + [f"x{i}_{j}" for j in range(8)])) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def test_one_of_each_group_stays(docs, no_docs):
    stay = without_near_duplicates(docs)
    assert stay.columns == docs.columns
    ids = Counter(r.doc_id for r in stay.collect())
    assert ids[1] == 1 and ids[11] == 1 and ids[7] == 1 and ids[None] == 2
    assert not {2, 3, 8, 12} & set(ids) and {4, 5, 6, 9, 10} <= set(ids)
    assert near_duplicates(no_docs).collect() == [] and without_near_duplicates(no_docs).collect() == []


# ---------------------------------------------------------------- repeated passages


def brute_repeats(rows):
    out, seen = [], set()
    for key, text, doc_id in sorted((-(1 << 63) if d is None else d, t or "", d) for d, t in rows):
        b = text.encode()
        covered = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if b[i : i + LENGTH] in seen:
                covered[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(b[i : i + LENGTH])
        kept = bytes(c for c, gone in zip(b, covered) if not gone)
        spans = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((doc_id, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_repeats_against_brute_force(spark):
    import random

    rng = random.Random(5)
    some = ["alpha", "beta", "dé", "x", "\n", "longerword", "q"]

    def text(n):
        return " ".join(rng.choice(some) + str(rng.randint(0, 99)) for _ in range(n))

    shared = [text(rng.randint(10, 60)) for _ in range(5)]
    rows = []
    for i in range(80):
        t = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            t += p[rng.randint(0, len(p) // 3) : len(p) - rng.randint(0, 20)] + text(rng.randint(0, 10))
        rows.append((i, t))
    rows += [(500, "a" * 700), (501, "ab" * 300), (502, None), (503, ""), (504, rows[3][1]), (505, "x" * 99), (None, rows[7][1])]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: tuple(r) for r in got} == {w[0]: w for w in brute_repeats(rows)}


def test_strings_of_large_samples_meet_one_by_one(spark, monkeypatch):
    rng = random.Random(6)
    phrase = "this common licence line stands in all documents"

    def text(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    shared = [text(30) + phrase + text(60) for _ in range(4)]
    rows = [(i, text(60) + rng.choice([phrase, *shared]) + text(60)) for i in range(60)] + [(90, text(50) + phrase), (91, "é" * 200 + phrase)]
    met = []
    single = repeats._single_strings
    monkeypatch.setattr(repeats, "_single_strings", lambda sent: met.append(len(sent.value)) or single(sent))
    for size in (1 << 21, 400, 0):
        monkeypatch.setattr(repeats, "SHARD_BYTES", size)
        got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert {r.doc_id: tuple(r) for r in got} == {w[0]: w for w in brute_repeats(rows)}
    assert len(met) == 2 and 0 < met[0] <= met[1]


def test_copies_of_a_row_are_one_document(spark, monkeypatch):
    rng = random.Random(7)
    one, two, three = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(3))
    rows = [(1, one + "1" + two), (1, one + "1" + two), (2, three + "2" + two)]
    for size in (1 << 21, 0):
        monkeypatch.setattr(repeats, "SHARD_BYTES", size)
        got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 200)]


def test_repeats_on_awkward_rows(docs, no_docs, rows):
    got = without_repeats(docs, with_text=False).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[2][0].n_removed == by[2][0].n_bytes > 0
    assert len({tuple(r) for r in by[12]}) == 1
    again = docs.where("doc_id = 9").unionAll(docs.where("doc_id = 9")).unionAll(docs.where("doc_id = 9"))
    assert [(r.n_removed, r.n_bytes > 10**5) for r in without_repeats(again).collect()] == [(0, True)] * 3
    assert without_repeats(no_docs).collect() == []


def test_parts_of_very_long_texts(spark, monkeypatch):
    from pagequarry.llm import repeats

    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 19) for i in range(3000))
    whole = repeats.samples(*repeats.utf8(pa.array([text])))
    monkeypatch.setattr(repeats, "PART_BYTES", 1000)
    monkeypatch.setattr(repeats, "slices", lambda s: iter([(0, 1)]))
    data, starts = repeats.utf8(pa.array([text]))
    strings = set()
    for rows, offsets, ends in repeats._parts(starts):
        row, at, count, sample = repeats.samples(data[ends[0] : ends[-1]], ends - ends[0])
        for a, n, s in zip(at + offsets[0], count, sample):
            strings.update((int(a) + k, int(s)) for k in range(n))
    assert strings == {(int(a) + k, int(s)) for a, n, s in zip(whole[1], whole[2], whole[3]) for k in range(n)}


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for turn in range(200):
        t = rng.integers(0, rng.integers(1, 6), rng.integers(0, 90)).astype(np.uint8)
        if turn % 5 == 0 and len(t):
            t = np.tile(t[: max(1, len(t) // 7)], 8)
        b = t.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert suffix_array(t).tolist() == want
        if len(b):
            common = [0]
            for i, j in zip(want[1:], want):
                n = 0
                while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                    n += 1
                common.append(n)
            assert permuted_common_prefixes(np.array(want), Prefixes(t)).tolist() == common


# ---------------------------------------------------------------- benchmark items


def test_contained_items(spark, docs, rows):
    items = [(1, " ".join(words(rows[0][1])[20:60])), (2, "two three"), (3, None), (4, " "), (None, "É ß"), (5, "not there at all ever")]
    items += [(6, rows[8][1]), (7, " ".join(words(rows[8][1])[-30:] + ["w"] * 3)), (1, " ".join(words(rows[0][1])[20:60]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = Counter()
    for doc_id, text, *_ in rows:
        for item_id, item in items:
            width = min(5, len(words(item)))
            if width:
                own, of = shingles(item, width), shingles(text, width) if len(words(text)) >= width else set()
                if 100 * len(own & of) >= 75 * len(own):
                    want[doc_id, item_id, len(own), len(own & of)] += 1
    assert Counter(tuple(r) for r in contaminated(docs, benchmark).collect()) == want
    clean = decontaminated(docs, benchmark)
    assert clean.columns == docs.columns
    bad = {w[0] for w in want}
    assert Counter(r.doc_id for r in clean.collect() if r.doc_id is not None) == Counter(r[0] for r in rows if r[0] not in bad and r[0] is not None)


def test_items_in_blocks_and_empty_tables(spark, docs, no_docs, monkeypatch):
    from pagequarry.llm import decontam

    benchmark = docs.select(F.col("doc_id").alias("item_id"), "text").where("doc_id between 100 and 110")
    whole = Counter(tuple(r) for r in contaminated(docs, benchmark).collect())
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 300)
    assert Counter(tuple(r) for r in contaminated(docs, benchmark).collect()) == whole
    assert contaminated(no_docs, benchmark).collect() == [] and decontaminated(no_docs, benchmark).collect() == []
    assert contaminated(docs, benchmark.limit(0)).collect() == []
    assert decontaminated(docs, benchmark.limit(0)).count() == docs.count()


# ---------------------------------------------------------------- token files


def test_elias_fano_round_trip():
    rng = np.random.default_rng(2)
    for most in (1, 2, 50, 10**7):
        for n in (1, 2, 63, 300):
            v = np.cumsum(rng.integers(0, most, n))
            code = EliasFano.encode(v)
            assert EliasFano(n, *code).select(np.arange(n)).tolist() == v.tolist()
            assert (len(code[1]) + len(code[2])) * 8 <= n * (3 + max(0, math.log2((v[-1] + 1) / n))) + 24
    assert EliasFano(0, *EliasFano.encode(np.zeros(0))).select(np.zeros(0, int)).tolist() == []


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    return path, lambda t: plain.encode(t or "", add_special_tokens=False).ids


def test_pieces_are_encoded_like_whole_texts():
    import random

    path, encode = library()
    coder, rng = Encoder(path), random.Random(3)
    some = [" ", " ,", "  ", "\n", "\t", "a", "B", "é", "1", "23", "'s", "'", "!!", "\x1c", "\x85", "\xa0", "　", "日本", "😀", "Ġ", "don't", "\r\n"]
    some += ["<|endoftext|>", "<|endoftext|", "|>"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for t, blob in zip(texts, coder.encode(texts)):
        assert np.frombuffer(blob, coder.dtype).tolist() == encode(t)


def test_words_with_marks_and_at_line_ends_are_put_together(monkeypatch):
    import random

    monkeypatch.setattr("pagequarry.llm.tokens.MEMORY_BYTES", 20_000)
    path, encode = library()
    coder, rng, sent = Encoder(path), random.Random(5), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    plain, coder.tokenizer = coder.tokenizer, Counted()
    assert coder.parts
    words = ["unbelievable", "Straßen", "ÉTÉ", "it's", "µm", "a", "ωα", "naïveté"]
    coder.encode(["first " + " ".join(words) + " x, y.\nunbelievable z"])
    sent.clear()
    texts = ["first unbelievable, Straßen. ÉTÉ, a.\nunbelievable. µm"]
    assert np.frombuffer(coder.encode(texts)[0], coder.dtype).tolist() == encode(texts[0])
    assert not any(w in t for w in words[:3] for t in sent)
    ends = ["", "", ",", ".", "...", ".\n", "\n", "\n\n", "!)\n\n", "\n\n\n", "\r\n", "'", "'s", "\u0301", "²", "7", "_", "\n ", " \n", " ", "-", "<|", "|>"]
    texts = ["".join(rng.choice(words) + rng.choice(ends) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for at in range(0, len(texts), 100):
        for t, blob in zip(texts[at : at + 100], coder.encode(texts[at : at + 100])):
            assert np.frombuffer(blob, coder.dtype).tolist() == encode(t)


def test_words_are_encoded_once_whatever_stands_around_them():
    import random

    path, encode = library()
    coder, rng, sent = Encoder(path), random.Random(7), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    plain, coder.tokenizer = coder.tokenizer, Counted()
    coder.encode(["an unbelievable\nunbelievable Straße"])
    sent.clear()
    texts = ["(unbelievable) [unbelievable]: 7unbelievable7 Straße\n\n\n unbelievable\t", "/unbelievable  unbelievable\n"]
    assert [np.frombuffer(b, coder.dtype).tolist() for b in coder.encode(texts)] == list(map(encode, texts))
    assert not any(w in t for w in ("unbelievable", "Straße") for t in sent)
    some = [*"a\u00df\u0175\u0416\u65e5\u0663\u00b2\u00d7\u0301\U0001f600(.'<|7_", "<|endoftext|>", "'re", "'S", *" \n\t\r\x0b\x1c\x1f\x00\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000\ufeff"]
    for often in ([], [" "] * 20, ["\n", " ", "'"] * 8):
        texts = ["".join(rng.choice(some + often) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
        assert [np.frombuffer(b, coder.dtype).tolist() for b in coder.encode(texts)] == list(map(encode, texts))


def test_texts_of_other_tokenizers_are_encoded_whole(tmp_path):
    from tokenizers import AddedToken, Tokenizer, normalizers, pre_tokenizers

    path, _ = library()
    texts = ["Ab  cd\n ef", "", "x <m> y<m>  <|endoftext|> z", " Ab"]
    changes = [
        lambda t: setattr(t, "normalizer", normalizers.Lowercase()),
        lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)),
        lambda t: t.add_special_tokens([AddedToken("<m>", lstrip=True)]),
        lambda t: t.add_special_tokens(["b  c"]),
    ]
    for change in changes:
        other = Tokenizer.from_file(path)
        change(other)
        other.save(str(tmp_path / "other.json"))
        coder = Encoder(str(tmp_path / "other.json"))
        want = [other.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(b, coder.dtype).tolist() for b in coder.encode(texts)] == want


def test_token_files(spark, docs, no_docs, rows):
    _, encode = library()
    spelled = [(20, "a <|endoftext|> b", None, None, None), (21, "<|endoftext|><|endoftext|>", None, None, None)]
    rows = rows + spelled
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(spelled, DOCS).select("doc_id", "text"))
    start, want = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = encode(text) + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenized(docs).collect()), key=lambda r: r[1]) == want
    assert tokenized(no_docs).collect() == []


# ---------------------------------------------------------------- licences


def test_licences(spark, docs, no_docs):
    mit = TEMPLATES["MIT"][1]
    w = mit.split(" ")
    texts = [
        "Copyright\n\n" + mit, "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) + "\n\nfoo bar baz", None, "", "MIT License",
        "released under the mit license", "x\nReleased under the MIT License.\r\ny", " ".join(w[:90]) + "\n\n" + " ".join(w[90:]),
        "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.",
    ]
    found = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {(r.doc_id, r.license, r.scope, r.line) for r in found.collect()}
    assert got == {
        (0, "MIT", "line", 2), (0, "MIT", "document", 0), (1, "MIT", "paragraph", 0), (1, "MIT", "document", 0), (5, "MIT", "line", 0),
        (6, "MIT", "line", 1), (6, "MIT", "paragraph", 0), (7, "MIT", "document", 0), (8, "CC-BY-4.0", "line", 0), (9, "CC-BY-NC-4.0", "line", 0),
    }
    assert scan_licenses(docs).collect() == [] and scan_licenses(no_docs).collect() == []


def best_passages(text, templates, least):
    """All runs of sentences of a text against all templates, the best ones that do not overlap."""

    def bigrams(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(t))
        return set(zip(w, w[1:]))

    sentences = [m.group() for m in re.finditer(r".*?(?:[.!?:;](?=[ \t\r\n]|$)|\n|$)", text, re.S) if m.group()]
    known = [(name, bigrams(t)) for name in sorted(templates) for t in templates[name]]
    runs = []
    for i in range(len(sentences)):
        for j in range(i, len(sentences)):
            own = bigrams("".join(sentences[i : j + 1]))
            for k, (name, want) in enumerate(known):
                if 200 * len(own & want) >= least * (len(own) + len(want)):
                    runs.append((-2 * len(own & want) / (len(own) + len(want)), j - i, i, k, j, name))
    taken = []
    for r in sorted(runs):
        if all(r[4] < a or r[2] > b for a, b, *_ in taken):
            taken.append((r[2], r[4], r[5], -r[0]))
    return sorted(("".join(sentences[:a]).count("\n"), name, round(d, 9)) for a, _, name, d in taken)


def test_passages_against_all_runs_of_sentences():
    rng = random.Random(12)
    vocabulary = "use of this work is free for all. any copy must keep notice; no warranty is given! ask us: first".split()
    templates = {n: tuple(" ".join(rng.choices(vocabulary, k=k)) for k in sizes) for n, sizes in (("A", (4, 30)), ("B", (12,)), ("C", (60, 7)))}
    known = Templates(templates, 80)
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            w = rng.choice(rng.choice(list(templates.values()))).split() if rng.random() < 0.6 else rng.choices([*vocabulary, "x.", "y"], k=rng.randrange(9))
            w = [x for x in w if rng.random() > 0.03]
            parts += [" ".join(w[: len(w) // 2]), rng.choice([" ", "\n", "\n\n", ". "]), " ".join(w[len(w) // 2 :]), rng.choice([" ", "\n", ".\n\n", "... "])]
        texts.append("".join(parts))
    data, starts = utf8(pa.array(texts))
    got = defaultdict(list)
    for row, w, begin, _, d in Passages(known, data, _PLAIN[data], starts).found():
        line = bytes(data[starts[row] : begin]).count(b"\n")
        got[row].append((line, known.names[w], round(d, 9)))
    for row, text in enumerate(texts):
        assert sorted(got[row]) == best_passages(text, templates, 80), text
    assert sum(map(len, got.values())) > 100


def test_licences_inside_longer_texts(spark):
    mit, apache, bsd = TEMPLATES["MIT"][1], TEMPLATES["Apache-2.0"][1], TEMPLATES["BSD-3-Clause"][1]
    own = [" ".join(f"word{i}x{k}" for k in range(40)) + "." for i in range(60)]

    def between(text, n):
        w = text.split(" ")
        cuts = [len(w) * k // n for k in range(n + 1)]
        return "\n\n".join(own[:3] + [" ".join(w[a:b]) for a, b in zip(cuts, cuts[1:])] + own[3:])

    texts = [
        between(mit, 3), between(apache, 3), "This module is part of the parser. Licensed under the Apache License, Version 2.0.",
        "\n\n".join(own), own[0] + "\n" + bsd.replace(". ", ".\n") + "\n" + " ".join(own), (mit.replace("sell", "lend") + " ") * 300 + mit,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[:4] for r in scan_licenses(df).collect()]
    assert sorted(got)[:4] == [
        (0, "MIT", "passage", 6), (1, "Apache-2.0", "passage", 6), (2, "Apache-2.0", "passage", 0), (4, "BSD-3-Clause", "passage", 1),
    ]
    assert {r[:3] for r in sorted(got)[4:]} == {(5, "MIT", "line")}
    assert scan_licenses(df, {}).collect() == []


# ---------------------------------------------------------------- language model


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(4)
    start, move, emit = rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)), rng.random((hmm.SYMBOLS, hmm.STATES))
    model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    sequences = [rng.integers(0, hmm.SYMBOLS, n) for n in (1, 2, 5, 40)]
    want = []
    for s in sequences:
        a = model.start * model.emit[s[0]]
        for x in s[1:]:
            a = (a @ model.move) * model.emit[x]
        want.append(math.log10(a.sum()))
    assert hmm.log_likelihoods(model, sequences) == pytest.approx(want)
    expected = hmm.Expected()
    expected.add(model, sequences)
    assert expected.emit.sum() == pytest.approx(sum(map(len, sequences)))
    assert expected.move.sum() == pytest.approx(sum(len(s) - 1 for s in sequences))
    assert expected.start.sum() == pytest.approx(len(sequences))


def test_expected_counts_against_all_paths():
    """The posterior of each state and move, summed over every path of states of short sequences."""
    import itertools

    rng = np.random.default_rng(9)
    start, move, emit = rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)), rng.random((hmm.SYMBOLS, hmm.STATES))
    model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    sequences = [rng.integers(0, 5, n) for n in (4, 1, 3, 3, 2)]
    want = hmm.Expected()
    for s in sequences:
        paths = np.array(list(itertools.product(range(hmm.STATES), repeat=len(s))))
        p = model.start[paths[:, 0]] * model.emit[s, paths].prod(1) * model.move[paths[:, :-1], paths[:, 1:]].prod(1)
        p /= p.sum()
        np.add.at(want.start, paths[:, 0], p)
        for t, x in enumerate(s):
            np.add.at(want.emit[x], paths[:, t], p)
            if t:
                np.add.at(want.move, (paths[:, t - 1], paths[:, t]), p)
    got = hmm.Expected()
    got.add(model, sequences)
    for name in ("start", "move", "emit"):
        assert getattr(got, name) == pytest.approx(getattr(want, name), rel=1e-4, abs=1e-6), name


def test_scores(spark, docs, no_docs, rows):
    got = hmm.score(docs).collect()
    counts = Counter()
    for doc_id, text, *_ in rows:
        if not hmm.held_out(doc_id):
            counts.update([*words(lower(text)), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for doc_id, text, *_ in rows:
        w = [*words(lower(text)), None]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want.append((str(doc_id), hmm.held_out(doc_id), len(w), sum(counts[x] > 0 for x in w), n, base))
    mine = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for g, w in zip(mine, sorted(want)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm.score(no_docs).collect() == []


def test_scores_do_not_depend_on_the_layout(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 9)))) for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: r.score for r in hmm.score(df.repartition(n, "doc_id")).collect()} for n in (2, 5))
    assert one == pytest.approx(two, rel=1e-6)


def test_held_out_likelihood_beats_the_base(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    own = hmm.score(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert own[1] > own[0]


# ---------------------------------------------------------------- mixing


def test_mix_meets_targets(docs, no_docs, rows):
    got = mix(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    total = sum(len(words(t)) for _, t, *_ in rows)
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * total)
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own)
        assert own[0].target <= 2 * own[0].source_size
        assert own[0].target - 1 - len(own) < sum(r.taken for r in own) <= own[0].target
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    again = sorted(map(str, mix(docs.repartition(7)).collect()))
    assert again == sorted(map(str, got))
    assert mix(no_docs).collect() == []


def test_mixed_documents_hold_the_words_taken(docs, no_docs):
    taken = {r.source: r.n for r in mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    rows = mixed_documents(docs)
    assert rows.columns == docs.columns
    held = {r.source: r.n for r in rows.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("n")).collect()}
    assert held == taken
    assert mixed_documents(no_docs).collect() == []


def test_mixed_documents_take_whole_texts(docs, no_docs, rows):
    plan = {r.source: r for r in mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = mixed_documents(docs, whole_texts=True)
    assert got.columns == docs.columns
    texts = {r[1] for r in rows}
    held, by_id = Counter(), defaultdict(list)
    for r in got.collect():
        assert r.text in texts
        held[r.source] += len(words(r.text))
        by_id[r.source, r.doc_id].append(len(words(r.text)))
    units = Counter()
    for doc_id, text, *_ in rows:
        units[doc_id] += len(words(text))
    for source, r in plan.items():
        assert abs(held[source] - r.n) <= max(units.values())
    again = mixed_documents(docs.repartition(5), whole_texts=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert mixed_documents(no_docs, whole_texts=True).collect() == []


def test_unique_runs_of_long_page():
    """A word goes if all its bytes are covered; half a million words, in 20,000 lines, take no call for each."""
    import time

    from pagequarry.llm.pages import LENGTH, unique_runs

    words = [f"é{i % 977}" + "x" * (i % 7) for i in range(500_000)]
    stream = "\n".join(" ".join(words[i : i + 25]) for i in range(0, len(words), 25))
    covered = list(range(0, len(stream.encode()) - LENGTH, 150))
    wanted = list(range(0, 20_000, 2))
    begin = time.process_time()
    got = unique_runs(stream, wanted, covered)
    assert time.process_time() - begin < 1.0
    gone, want, at = bytearray(len(stream.encode())), [], 0
    for c in covered:
        gone[c : c + LENGTH] = b"\1" * LENGTH
    for i, line in enumerate(stream.split("\n")):
        for word in line.split(" "):
            n = len(word.encode())
            if i % 2 == 0 and not all(gone[at : at + n]):
                want.append(word)
            at += n + 1
    assert got == " ".join(want)
    assert unique_runs("a b\nc", [1], None) == "c" and unique_runs("a b\nc", [], [0]) == ""
