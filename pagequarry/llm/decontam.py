"""Benchmark decontamination: short test items found inside long documents.

A document holds an item if at least 75 percent of the item's distinct five-word
shingles are among the document's (an item of fewer words is searched for as one
run of that many words).  Candidates come from MinHash with one permutation: the
range of the hashes is cut into bins, a signature has the least hash of each bin,
and a document and an item meet where a bin has the same value.  Containment does
not get weaker with the length of a document, because items and documents are
partitioned by size and the number of bins follows both: for items of at least m
needed shingles in documents of at most n, bins are so many that a needed shingle
is not the least of its bin with a probability of at most ``MISS ** (1 / m)``.
Every candidate is confirmed on the full sets.

The items go to the executors in blocks of at most ``BLOCK_SHINGLES`` shingles, so
any number of items is searched in bounded memory; documents are not shuffled.

Defined cases: items and documents that are null or have no words match nothing;
repeated items or documents are each reported; null ids are reported as null;
empty tables give an empty result; other columns are left alone.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.words import U, WIDTH, Words, each_slice, slices, utf8
from pagequarry.sources.lineage import written

LEAST_PERCENT = 75
#: Odds that the search misses an item that has just enough shingles.
MISS = 1e-9
#: 32 MB of shingles at once.
BLOCK_SHINGLES = 1 << 22
_FILTER = 1 << 20


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = utf8(batch.column(1))
        for lo, hi in slices(starts):
            words = Words(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
            width = np.minimum(words.counts(), WIDTH)
            sets: list = [None] * (hi - lo)
            for w in range(1, WIDTH + 1):
                shingles, begins = words.shingles(w)
                for i in np.flatnonzero(width == w):
                    sets[i] = np.unique(shingles[begins[i] : begins[i + 1]]).view(np.int64)
            full = [i for i, s in enumerate(sets) if s is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo).take(pa.array(full, pa.int64())),
                    pa.array(width[full], pa.int32()),
                    pa.array([sets[i] for i in full], pa.list_(pa.int64())),
                ],
                names=["item_id", "width", "shingles"],
            )


class Items:
    """A block of items, partitioned by shingle width and size."""

    def __init__(self, items: list[tuple[int | None, int, np.ndarray]]):
        self.items = items
        groups = defaultdict(list)
        for i, (_, width, shingles) in enumerate(items):
            groups[width, len(shingles).bit_length()].append(i)
        self.groups = []
        for (width, size), own in sorted(groups.items()):
            needed = math.ceil(LEAST_PERCENT * (1 << (size - 1)) / 100)
            values = np.concatenate([items[i][2] for i in own])
            owners = np.repeat(np.array(own), [len(items[i][2]) for i in own])
            # a shingle is the least of its item's bin if it and its neighbour below differ in the bits that name the bin
            differ = np.concatenate([np.append(U(2**64 - 1), items[i][2][1:] ^ items[i][2][:-1]) for i in own])
            order = np.argsort(values, kind="stable")
            values = values[order]
            bloom = np.zeros(_FILTER, bool)
            bloom[values & U(_FILTER - 1)] = True
            self.groups.append((width, 2 * MISS ** (1 / needed), values, owners[order], differ[order], bloom))
        self.widths = sorted({g[0] for g in self.groups})

    def search(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """``(row, item, shared)`` for each document that holds an item."""
        for width in self.widths:
            hashes, begins = words.shingles(width)
            for a, b in zip(begins[:-1], begins[1:]):
                hashes[a:b].sort()
            rows = np.repeat(np.arange(words.rows), np.diff(begins))
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            hashes, rows = hashes[fresh], rows[fresh]
            if not len(hashes):
                continue
            begins = np.searchsorted(rows, np.arange(words.rows + 1))
            below = np.empty_like(hashes)
            below[1:] = hashes[1:] ^ hashes[:-1]
            below[begins[:-1][begins[:-1] < len(hashes)]] = U(2**64 - 1)
            size = np.ceil(np.log2(np.maximum(np.diff(begins), 1) + 1))
            for own, load, values, owners, differ, bloom in self.groups:
                if own != width:
                    continue
                bits = np.clip(size + math.ceil(-math.log2(min(load, 1))), 1, 64)
                shift = (64 - bits).astype(U)[rows]
                hit = np.flatnonzero(bloom[hashes & U(_FILTER - 1)])
                hit = hit[(below[hit] >> shift[hit]) > 0]
                lo, hi = np.searchsorted(values, hashes[hit], "left"), np.searchsorted(values, hashes[hit], "right")
                pairs = set()
                for at, a, b in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo]):
                    meets = (differ[a:b] >> shift[at]) > 0
                    pairs.update((int(rows[at]), int(o)) for o in owners[a:b][meets])
                for row, i in sorted(pairs):
                    item = self.items[i][2]
                    own_set = hashes[begins[row] : begins[row + 1]]
                    place = np.minimum(np.searchsorted(own_set, item), len(own_set) - 1)
                    shared = int((own_set[place] == item).sum())
                    if 100 * shared >= LEAST_PERCENT * len(item):
                        yield row, i, shared


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of items; each comes to the driver alone."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(rows.mapInArrow(_item_rows, "item_id long, width int, shingles array<bigint>"))
    total = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    n = 1 + total // BLOCK_SHINGLES
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(n)) == k) if n > 1 else items
        yield Items([(r.item_id, r.width, np.array(r.shingles, np.int64).view(U)) for r in own.collect()])


_HITS = "doc_id long, item_id long, n_item_shingles long, n_shared long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_shared`` for each document that holds an item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def hits(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                found = [(lo + r, i, n) for lo, _, w in each_slice(batch.column(1)) for r, i, n in items.search(w)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([items.items[f[1]][0] for f in found], pa.int64()),
                        pa.array([len(items.items[f[1]][2]) for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "n_item_shingles", "n_shared"],
                )

        return run

    out = None
    for block in _blocks(benchmark):
        one = texts.mapInArrow(hits(spark.sparkContext.broadcast(block)), _HITS)
        out = one if out is None else out.unionAll(one)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are."""
    spark, at = docs.sparkSession, docs.columns.index("text")

    def clean(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, words in each_slice(batch.column(at)):
                    keep[np.fromiter((lo + r for r, _, _ in sent.value.search(words)), np.int64)] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in _blocks(benchmark):
        docs = docs.mapInArrow(clean(spark.sparkContext.broadcast(block)), docs.schema)
    return docs
