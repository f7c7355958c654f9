"""How the sources of a language differ in their words, and which terms make a source stand out.

A term is a run of letters: ``A-Z`` (lower-cased), ``a-z`` and everything beyond
ASCII.  A language keeps the terms that enough of its documents hold.  A group, a
language and one of its sources, gives each kept term a share in billionths, smoothed;
all arithmetic is on whole numbers.

Texts are counted per group and term within a task before anything is shuffled;
one exchange by language and term then gives counts, document counts and language
counts at once.  Within a task terms are told by 64-bit hashes.

*Terms of a group.*  The surplus of a term over its language grows with its count in
the group and falls with its count in the language; ties go to the earlier in UTF-8.
So a term that ``k`` others dominate in all three cannot be among the first ``k``.
Every partition keeps the terms that fewer than ``k`` of its own dominate, the
survivors of a group meet and are reduced the same way, and only what is left is
given shares and ranked.  Counting dominators among survivors is enough: if a term
has ``k`` dominators, the ``k`` of them with the fewest dominators survive.

*Pairs of sources.*  The distance of two sources is a sum over all kept terms.  Terms
are dealt to blocks of bounded size, in which all sources of the language are compared
as rows of a matrix; only sums per pair and block leave it.

Defined cases: null ``text``, ``lang`` and ``source`` are empty strings; a group without
terms has rows of pairs, its shares those of zero counts; a language that keeps nothing
has distances of 0 and no terms; every row is a document, also if it repeats another or
shares its id; texts are counted whole, a very long one in pieces, as one document; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.words import SLICE_BYTES, U, _powers, mixed, slices, utf8
from pagequarry.sources.lineage import new_folder, remove_folder, written

LEAST_DOCS, RANKS = 30, 50
#: Shares are in billionths, each count raised by 5.
SCALE, SMOOTHING = 1_000_000_000, 5
#: Rows that a task gathers before it gives them out; cells of a block of sources and terms.
TALLY_ROWS, CELLS = 1 << 20, 1 << 18
BAND_BLOCK = 512

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUES = np.where(_LETTER, mixed(_LOWER.astype(U) * U(0x2545F4914F6CDD1D) + U(1)), U(0))


def term_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte, hash and number of the text of each term of some texts."""
    letter = _LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    begin = np.flatnonzero(letter & (np.concatenate(([True], ~letter[:-1])) | cut[:-1])) if len(data) else np.zeros(0, np.int64)
    if not len(begin):
        return begin, begin, np.zeros(0, U), begin
    end = np.flatnonzero(letter & (np.concatenate((~letter[1:], [True])) | cut[1:])) + 1
    power, inverse = _powers(len(data) + 1)
    sums = np.add.reduceat(_VALUES[data] * power[: len(data)], begin)
    return begin, end, mixed(sums * inverse[begin]), np.searchsorted(starts, begin, "right") - 1


def pieces(data: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Parts of one long text that cut no term."""
    lo = 0
    while lo < len(data):
        hi = lo + most
        while hi < len(data):
            gap = np.flatnonzero(~_LETTER[data[hi : hi + most]])
            hi += int(gap[0]) if len(gap) else most
            if len(gap):
                break
        hi = min(hi, len(data))
        yield lo, hi
        lo = hi


def strings_at(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Lower-cased stretches of some bytes as an Arrow column."""
    size = end - begin
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
    bytes_ = _LOWER[data[at]]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(bytes_)])


class Tally:
    """Occurrences and documents per group and term of the texts of a task, given out in parts of bounded size."""

    def __init__(self, most: int = TALLY_ROWS):
        self.most = most
        self.names: dict[tuple[str, str], int] = {}
        self.parts: list[tuple] = []
        self.size = 0

    def groups(self, langs: pa.Array, sources: pa.Array) -> np.ndarray:
        known = self.names
        return np.array([known.setdefault(k, len(known)) for k in zip(langs.to_pylist(), sources.to_pylist())], np.int64)

    def add(self, data, spans, group: np.ndarray, seen: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Count the terms ``spans`` of some texts, whose groups these are; terms in ``seen`` are not new in their document."""
        begin, end, hashes, doc = spans
        _, first, times = np.unique(mixed(hashes + doc.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        new = np.ones(len(first), np.int64) if seen is None else (~np.isin(hashes[first], seen)).astype(np.int64)
        of = group[doc[first]]
        keys = mixed(hashes[first] + (of.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
        keys, at, g, docs = _summed(keys, times, new)
        at_term = first[at]
        self.parts.append((keys, of[at], g, docs, strings_at(data, begin[at_term], end[at_term])))
        self.size += len(keys)
        if self.size > self.most:
            self._merge()
            if 2 * self.size > self.most:
                yield from self.rest()

    def _merge(self) -> None:
        keys, of, g, docs = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        terms = pa.concat_arrays([p[4] for p in self.parts])
        keys, at, g, docs = _summed(keys, g, docs)
        self.parts = [(keys, of[at], g, docs, terms.take(pa.array(at)))]
        self.size = len(keys)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._merge()
            _, of, g, docs, terms = self.parts[0]
            langs, sources = (pa.array([k[i] for k in self.names], pa.string()).take(pa.array(of)) for i in (0, 1))
            columns = [langs, sources, terms.cast(pa.string()), pa.array(g), pa.array(docs)]
            whole = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "g", "docs"])
            for lo in range(0, self.size, 65_536):
                yield whole.slice(lo, 65_536)
        self.parts, self.size = [], 0


def _summed(keys: np.ndarray, g: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each is found first, and the sums of ``g`` and ``docs``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    if not len(starts):
        return keys, order, g[:0].astype(np.int64), docs[:0]
    return keys[starts], order[starts], np.add.reduceat(g[order].astype(np.int64), starts), np.add.reduceat(docs[order], starts)


_COUNTED = "lang string, source string, term string, g long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(batches, Tally())


def _counted(batches: Iterator[pa.RecordBatch], tally: Tally) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = utf8(batch.column(2))
        for lo, hi in slices(starts):
            group = tally.groups(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))
            own = data[starts[lo] : starts[hi]]
            if len(own) <= SLICE_BYTES:
                yield from tally.add(own, term_spans(own, starts[lo : hi + 1] - starts[lo]), group)
                continue
            seen = np.zeros(0, U)
            for a, b in pieces(own):
                spans = term_spans(own[a:b], np.array([0, b - a]))
                yield from tally.add(own[a:b], spans, group, seen)
                seen = np.union1d(seen, spans[2])
    yield from tally.rest()


class Band:
    """The terms of one group, in UTF-8 order, that fewer than ``k`` earlier ones dominate."""

    def __init__(self, k: int):
        self.k, self.g, self.c = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def keep(self, g: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which of the next terms stay; those are remembered."""
        out = np.zeros(len(g), bool)
        for lo in range(0, len(g), BAND_BLOCK):
            gs, cs = g[lo : lo + BAND_BLOCK], c[lo : lo + BAND_BLOCK]
            over = ((self.g >= gs[:, None]) & (self.c <= cs[:, None])).sum(axis=1)
            left = np.flatnonzero(over < self.k)
            if len(left):
                gl, cl = gs[left], cs[left]
                inner = (gl >= gl[:, None]) & (cl <= cl[:, None])
                left = left[over[left] + np.tril(inner, -1).sum(axis=1) < self.k]
            out[lo + left] = True
            self.g, self.c = np.append(self.g, gs[left]), np.append(self.c, cs[left])
        return out


def _skyband(k: int):
    """Rows ``lang, source, term, g, c`` come sorted by the first three."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, band = None, Band(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            key = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            g, c = (batch.column(i).to_numpy() for i in (3, 4))
            cuts = np.flatnonzero(np.diff(key)) + 1
            stay = np.zeros(len(g), bool)
            for a, b in zip([0, *cuts], [*cuts, len(g)]):
                name = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if name != last:
                    last, band = name, Band(k)
                stay[a:b] = band.keep(g[a:b], c[a:b])
            yield batch.filter(pa.array(stay))

    return keep


def skyband(rows: DataFrame, k: int = RANKS) -> DataFrame:
    """Of ``lang, source, term, g, c`` the terms that fewer than ``k`` others of their group dominate."""
    rows = rows.select("lang", "source", "term", "g", "c")
    order = ["lang", "source", "term"]
    for by in (None, ["lang", "source"]):
        dealt = rows if by is None else rows.repartition(*by)
        rows = dealt.sortWithinPartitions(*order).mapInArrow(_skyband(k), rows.schema)
    return rows


_SUMS = "lang string, a long, b long, value long"


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, block, term, place, p`` come sorted; those without a term come first and give each source its least share."""
    held: list[pa.Table] = []
    last = None

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        head = rows.column("term").is_null().to_numpy()
        place, p = rows.column("place").to_numpy(), rows.column("p").to_numpy()
        terms = rows.column("term").filter(pa.array(~head)).combine_chunks().dictionary_encode()
        shares = np.repeat(p[head][np.argsort(place[head])][:, None], max(len(terms.dictionary), 1), axis=1)
        if len(terms):
            shares[place[~head], terms.indices.to_numpy()] = p[~head]
        else:
            shares = shares[:, :0]
        for a in range(len(shares) - 1):
            sums = np.abs(shares[a + 1 :] - shares[a]).sum(axis=1)
            n = len(sums)
            columns = [pa.array([last[0]] * n, pa.string()), pa.array(np.full(n, a)), pa.array(np.arange(a + 1, a + 1 + n)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lang = batch.column(0).dictionary_encode()
        key = np.stack((lang.indices.to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int64)), axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            name = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
            if name != last and held:
                yield from out()
                held = []
            last = name
            held.append(batch.slice(a, b - a))
    if held:
        yield from out()


def share(count: str, total: str, kept: str) -> Column:
    """Exact, also for counts beyond 64 bits times a billion."""
    return F.expr(f"1L + (cast({count} + {SMOOTHING} as decimal(20,0)) * {SCALE}) div ({total} + {SMOOTHING}L * {kept})")


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each two sources of a language.

    ``groups`` is ``lang, source, n, kept_terms``; its rows of a language are numbered in a window: as many
    as the sources, whose pairs are the result.
    """
    by_lang = Window.partitionBy("lang")
    least = F.when(F.col("kept_terms") > 0, share("0", "n", "kept_terms")).otherwise(F.lit(0)).alias("p")
    place = (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("place")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*").over(by_lang) * F.col("kept_terms") / CELLS)).cast("int").alias("blocks")
    placed = written(groups.select("lang", "source", "n", "kept_terms", place, least, blocks))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    shares = kept.join(placed.drop("p"), ["lang", "source"])
    shares = shares.select("lang", block, "term", "place", share("g", "n", "kept_terms").alias("p"))
    none = F.lit(None).cast("string").alias("term")
    head = placed.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), none, "place", "p")
    dealt = shares.unionByName(head).repartition("lang", "block").sortWithinPartitions("lang", "block", F.col("term").asc_nulls_first())
    sums = dealt.mapInArrow(_distances, _SUMS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("pair")
    sums = sums.select("lang", "value", both).select("lang", "value", "pair.a", "pair.b")
    one = placed.select("lang", F.col("place").alias("a"), "source")
    two = placed.select("lang", F.col("place").alias("b"), F.col("source").alias("item"))
    return sums.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "source", "item", "value")


def standing_out(kept: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """``lang, source, item, value``: candidates for the first terms of each group by what its share exceeds the language's."""
    of_lang = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    found = skyband(kept, ranks).join(groups, ["lang", "source"]).join(of_lang, "lang")
    value = share("g", "n", "kept_terms") - share("c", "lang_n", "kept_terms")
    return found.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources (``pair``) and telling terms (``term``)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = docs.select(text("lang"), text("source"), text("text"))
    partial = own.mapInArrow(_count, _COUNTED)
    # one exchange serves the counts of groups, documents and languages
    counts = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("g").alias("g"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("c", F.sum("g").over(term)).withColumn("in_docs", F.sum("docs").over(term))
    first = (F.row_number().over(term.orderBy("source")) == 1).cast("long").alias("first")
    folder = new_folder(docs.sparkSession, "kept")
    kept = written(counts.select("lang", "source", "term", "g", "c", "in_docs", first).where(F.col("in_docs") >= least_docs), folder)
    n = kept.groupBy("lang", "source").agg(F.sum("g").alias("n"))
    terms = kept.groupBy("lang").agg(F.sum("first").alias("kept_terms"))
    groups = own.select("lang", "source").distinct().join(n, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = written(groups.fillna(0, ["n", "kept_terms"]))
    parts = [("pair", source_pairs(kept, groups), None), ("term", standing_out(kept, groups, ranks), ranks)]
    out = None
    for part, rows, most in parts:
        best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        ranked = rows.withColumn("rank", F.row_number().over(best))
        ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
        ranked = ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        out = ranked if out is None else out.unionByName(ranked)
    out = written(out)
    remove_folder(docs.sparkSession, folder)
    return out
