"""Near duplicates by circulant MinHash.

The distinct five-word shingles of a text are mapped by one permutation of the
32-bit integers; signature coordinate k is the least value of a second
permutation of them, its argument shifted circularly by k.  Two permutations so
give all coordinates.  Bands of coordinates propose pairs, and every link is
confirmed on the full shingle sets.

No bucket is expanded into pairs.  Texts with the same set are one class and only
its smallest document goes on.  In each bucket one member, the hub, is compared
with the others; for most buckets this leaves one component.  The members of the
rest are compared among each other in blocks of bounded size, a task at a time, by
exact counts of common shingles; what comes out are links between components, no
more than connect them.  So each proposed pair is compared or already connected,
whatever the size of the bucket.

Defined cases: a text with fewer than five words is one shingle; a text without
words, or a null, has none and is linked with nothing; rows without ``doc_id`` are
linked with nothing (``component_id`` null, ``kept`` true); rows that share a
``doc_id`` are one document, linked by any of its texts; of equal rows all get
the same result; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.components import connected
from pagequarry.llm.tables import ids_for_join
from pagequarry.llm.words import U, Words, each_slice, mixed
from pagequarry.sources.lineage import written

BANDS, ROWS = 32, 4
LEAST_PERCENT = 75
BLOCK = 1 << 15
#: Of a block of sets that are compared with each other, or with another block.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 19, 1024


def distinct_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and where each text's begin."""
    shingles, begins = words.shingles()
    for a, b in zip(begins[:-1], begins[1:]):
        shingles[a:b].sort()
    keep = np.ones(len(shingles), bool)
    keep[1:] = shingles[1:] != shingles[:-1]
    keep[begins[:-1][begins[:-1] < len(shingles)]] = True
    return shingles[keep], np.concatenate(([0], np.cumsum(keep)))[begins]


def circulant_minima(shingles: np.ndarray, begins: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """``size`` coordinates for each of some non-empty sets, one row per coordinate."""
    out = np.empty((size, len(begins)), np.uint32)
    first = (mixed(shingles) >> U(32)).astype(np.uint32)
    ends = np.append(begins[1:], len(first))
    lo = 0
    while lo < len(begins):
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + BLOCK, "right")))
        block, at = first[begins[lo] : ends[hi - 1]], begins[lo:hi] - begins[lo]
        y, z = np.empty_like(block), np.empty_like(block)
        for k in range(size):
            np.subtract(block, np.uint32(k), out=y)
            np.multiply(y, np.uint32(0x85EBCA6B), out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0xC2B2AE35), out=y)
            np.right_shift(y, np.uint32(13), out=z)
            np.bitwise_xor(y, z, out=y)
            np.minimum.reduceat(y, at, out=out[k, lo:hi])
        lo = hi
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    keys = []
    for band in range(len(minima) // ROWS):
        key = np.full(minima.shape[1], band + 1, U)
        for row in minima[band * ROWS : (band + 1) * ROWS]:
            key = mixed(key * U(0x9E3779B97F4A7C15) + row.astype(U))
        keys.append(key)
    return np.array(keys, U).T


_SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<bigint>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in each_slice(batch.column(1)):
            shingles, begins = distinct_sets(words)
            count = np.diff(begins)
            full = np.flatnonzero(count)
            k1, k2 = np.zeros(hi - lo, U), np.zeros(hi - lo, U)
            bands = np.zeros((0, BANDS), U)
            if len(full):
                at = begins[:-1][full]
                k1[full] = np.add.reduceat(mixed(shingles ^ U(0x5BD1E995)), at)
                k2[full] = np.add.reduceat(mixed(shingles * U(0x27D4EB2F165667C5)), at)
                bands = band_keys(circulant_minima(shingles, at))
            ends = np.concatenate(([0], np.cumsum(np.where(count > 0, BANDS, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(count, pa.int64()),
                    pa.array(k1.view(np.int64)),
                    pa.array(k2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in each_slice(batch.column(1)):
            shingles, begins = distinct_sets(words)
            sets = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], names=["rep", "shingles"])


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, k1, k2, bands``; ``k1, k2`` name the set."""
    return _named(docs).mapInArrow(_signatures, _SIGNED)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(two, "b").join(one, "a")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    return both.where(f"100L * i >= {LEAST_PERCENT}L * (na + nb - i)").select("a", "b")


def _block_links(rows: pa.Table) -> list[tuple[int, int]]:
    """Links between components among some sets, enough to connect them; across two blocks, or within one.

    Intersections of all sets are counted exactly, as products of the matrix of sets and shingles.
    """
    block, rep, comp = (rows.column(n).to_numpy() for n in ("block", "rep", "comp"))
    sets = rows.column("shingles").combine_chunks()
    size = sets.value_lengths().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    _, column, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    again = times[column] > 1
    owner, column = owner[again], (np.cumsum(times > 1) - 1)[column[again]]
    common = np.zeros((len(size), len(size)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        part = np.zeros((len(size), 2048), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    near = 100 * common >= LEAST_PERCENT * (size[:, None] + size[None, :] - common)
    near &= comp[:, None] < comp[None, :]
    if rows.column("one")[0].as_py() != rows.column("two")[0].as_py():
        near &= block[:, None] != block[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for x, y in np.argwhere(near):
        a, b = root(int(comp[x])), root(int(comp[y]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(rep[x]), int(rep[y])))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and pair of blocks; a group has two blocks at most."""
    held: list[pa.RecordBatch] = []
    last = None

    def out() -> pa.RecordBatch:
        links = _block_links(pa.Table.from_batches(held))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            key = tuple(keys[lo])
            if key != last and held:
                yield out()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield out()


def _links(members: DataFrame, sets: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, comp`` from the buckets ``bucket, rep, n, mix``, beginning with some sure ``edges``."""

    def labelled(labels: DataFrame) -> DataFrame:
        named = labels.select(F.col("node").alias("rep"), "comp")
        return members.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    labels = written(connected(edges))
    live = labelled(labels)
    hubs = members.groupBy("bucket").agg(F.min("mix").alias("mix"))
    hub = live.join(hubs, ["bucket", "mix"]).select("bucket", *[F.col(c).alias(f"hub_{c}") for c in ("rep", "n", "comp")])
    near = live.join(hub, "bucket").where("comp <> hub_comp")
    near = near.where(f"100L * least(n, hub_n) >= {LEAST_PERCENT}L * greatest(n, hub_n)")
    pairs = near.select(F.least("rep", "hub_rep").alias("a"), F.greatest("rep", "hub_rep").alias("b")).distinct()
    known = labels.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    labels = written(connected(known.unionByName(linked(pairs, sets))))

    # what a hub has not connected: members but the hub, of buckets with two components or more
    rest = written(labelled(labels).join(hubs, ["bucket", "mix"], "left_anti"))
    open_ = rest.groupBy("bucket").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("shingles"), F.count("*").alias("sets")
    )
    many = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")
    open_ = open_.where("lo <> hi").select("bucket", many.alias("blocks"))
    rest = rest.join(open_, "bucket").withColumn("block", F.pmod("mix", F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rest = rest.select("bucket", "rep", "comp", "block", others.alias("other"))
    rest = rest.select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rep", "comp")
    groups = rest.join(sets, "rep").select("bucket", "one", "two", "block", "rep", "comp", "shingles")
    key = ["bucket", "one", "two"]
    groups = groups.repartition(*key).sortWithinPartitions(*key)
    found = written(groups.mapInArrow(_blocks, "a long, b long"))
    known = labels.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return written(connected(known.unionByName(found)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row."""
    signed = written(signatures(docs))
    named = signed.where("doc_id is not null and n_shingles > 0")
    by = ["n_shingles", "k1", "k2"]
    classes = named.groupBy(*by).agg(F.min("doc_id").alias("rep"))
    rows = signed.join(classes, by, "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.col("rep")))
    first = F.col("doc_id") == F.col("rep")
    rows = written(rows.select("doc_id", "n_shingles", "rep", F.when(first, F.col("bands")).alias("bands")))
    again = rows.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    again = again.where("lo <> hi").select("doc_id")
    sure = rows.join(again, "doc_id", "left_semi").where("rep is not null")
    sure = sure.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    buckets = rows.where("bands is not null").select(F.col("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    members = buckets.join(shared.select("bucket"), "bucket").distinct().withColumn("mix", F.xxhash64("rep"))
    members = written(members)
    wanted = ids_for_join(written(members.select("rep").distinct()))
    texts = _named(docs)
    texts = texts.join(wanted, texts["doc_id"] == wanted["rep"], "left_semi")
    sets = written(texts.mapInArrow(_sets, "rep long, shingles array<bigint>"))

    labels = _links(members, sets, sure).select(F.col("node").alias("rep"), "comp")
    out = rows.select("doc_id", "n_shingles", "rep").join(labels, "rep", "left")
    component = F.coalesce("comp", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group.

    Of rows that share a ``doc_id`` the one with the first text stays.
    """
    found = written(near_duplicates(docs))
    gone = ids_for_join(written(found.where("not kept").select(F.col("doc_id").alias("_gone_id")).distinct()))
    stay = docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    again = written(again.select(F.col("doc_id").alias("_again_id")))
    if again.isEmpty():
        return stay
    again = ids_for_join(again)
    single = stay.join(again, stay["doc_id"] == again["_again_id"], "left_anti")
    several = stay.join(again, stay["doc_id"] == again["_again_id"], "left_semi")
    row = several.select(F.struct(*[several[c] for c in several.columns]).alias("_row"))
    place = Window.partitionBy("_row.doc_id").orderBy(F.col("_row.text").asc_nulls_last())
    row = row.withColumn("_place", F.row_number().over(place)).where("_place = 1")
    return single.unionAll(row.select("_row.*"))
