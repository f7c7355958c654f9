"""Join of documents by the Jaccard similarity of their word n-grams, with PartEnum signatures.

Two sets of sizes ``a`` and ``b`` with a similarity of ``P`` percent differ in at most
``H = (a + b)(100 - P) / (100 + P)`` elements.  Sizes are cut into bands that overlap by
one factor of ``100 / P``, so the sets of every link share a band.  A band partitions
the 64-bit hashes into ``parts`` ranges and each of these into ``cells``.  At most
``H / (tolerance + 1)`` parts differ in more than ``tolerance`` elements; in any other
part some subset of ``cells - tolerance`` cells agrees.  So with a signature for each
part and each such subset of its cells, linked sets share one; nothing is left to chance.

Empty cells say nothing, so a signature needs an element.  A part is *full* for a
set if enough of its cells are occupied that an agreeing subset must hold an element; a set
signs the parts, in order, until it has signed one full part more than may differ.
Of two linked sets the one that ends first has a full part, in which both sign what
they share.  Sets that run out of parts sign again with the hashes mixed anew; two of them meet
there, or, after the last round, under a signature of the band.

Equal sets are one class, and only classes sign.  In each bucket of a signature
the least class, the hub, is compared with the others, all by their full sets, each set
moved once per hub; many buckets have the same members, and each pair is compared once.
Members of a bucket that are connected already need no comparison.  Buckets which still hold
several components are compared in blocks of bounded size, those that hang together as
one family if that moves less: the largest component in blocks of its own, each moved once per block of
the others, and the others among themselves.  If blocks would move too much, buckets
get further hubs first.  So no bucket is expanded into pairs, and a large group of near
copies with some odd members costs in proportion to its size.

Links inside a component are not counted one by one: a group of n near copies has up to
n^2/2 of them.  The component of each document is exact.

Defined cases: a text with fewer words than a shingle is one shingle; a text without words, or a
null, has none and is linked with nothing; rows without ``doc_id`` are linked with nothing
(``component_id`` null); rows that share a ``doc_id`` are one document, linked by any of its
texts; of equal rows all get the same result; whole texts of any length are read; an empty
table gives an empty result; other columns are not looked at.  Shingles are compared by
64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.components import connected
from pagequarry.llm.tables import ids_for_join
from pagequarry.llm.words import U, Words, each_slice, mixed
from pagequarry.sources.lineage import new_folder, remove_folder, written

WIDTH, LEAST_PERCENT = 4, 85
#: A band of sizes covers so many factors of 100 / percent.
FACTORS = 5
#: Rounds of signing for sets that run out of parts.
ROUNDS = 3
#: Hubs per bucket at most, before blocks; these come as soon as they move no set more often than this, on average.
HUBS, COPIES = 4, 4
#: Members of a hub compared in one task; sets and shingles of a block.
HUB_MEMBERS, BLOCK_SETS, BLOCK_SHINGLES = 2048, 1024, 1 << 19
#: Rows of places that may be sent to every executor: some 10 MB.
PLACES_TO_SEND = 200_000


def most_differing(a, b, percent: int = LEAST_PERCENT):
    """Elements in which linked sets of these sizes can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


@dataclass(frozen=True)
class SizeBand:
    """Sizes ``lo`` to ``hi``, cut into ``parts`` of ``cells``; signatures leave out ``tolerance`` cells of a part."""

    number: int
    lo: int
    hi: int
    parts: int
    cells: int
    tolerance: int


def _band(number: int, lo: int, hi: int, percent: int) -> SizeBand:
    most = most_differing(hi, hi, percent)
    if most <= 4:
        return SizeBand(number, lo, hi, 1, most + 2 if most else 1, most)
    must = most // 2 + 1
    return SizeBand(number, lo, hi, must + 1 + must // 16, 3, 1)


@lru_cache(16)
def size_bands(largest: int, percent: int = LEAST_PERCENT) -> tuple[SizeBand, ...]:
    """The bands up to a size; any two sizes of a link up to it share one."""
    out, lo = [], 1
    while lo <= largest:
        hi = lo
        for _ in range(FACTORS):
            hi = hi * 100 // percent
        while lo * 100 // percent > hi:
            hi += 1
        # sets of up to 'ends' have all their larger partners within 'hi'
        ends = lo
        while (ends + 1) * 100 // percent <= hi:
            ends += max(1, (hi * percent // 100 - ends - 1))
        if most_differing(hi, hi, percent):
            out.append(_band(len(out), lo, hi, percent))
        lo = ends + 1
    return tuple(out)


def distinct_shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and where each text's begin."""
    shingles, begins = words.shingles(width)
    for a, b in zip(begins[:-1], begins[1:]):
        shingles[a:b].sort()
    keep = np.ones(len(shingles), bool)
    keep[1:] = shingles[1:] != shingles[:-1]
    keep[begins[:-1][begins[:-1] < len(shingles)]] = True
    return shingles[keep], np.concatenate(([0], np.cumsum(keep)))[begins]


def _sign(band: SizeBand, shingles: np.ndarray, size: np.ndarray, turn: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the set and signature, for some non-empty sets one after the other; and which sets ran out of parts."""
    n, width = len(size), band.parts * band.cells
    hashes = shingles if turn == 0 else mixed(shingles + U(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    cell = (((hashes >> U(32)) * U(width)) >> U(32)).astype(np.int64) + np.repeat(np.arange(n) * width, size)
    if turn:
        order = np.argsort(cell, kind="stable")
        cell, hashes = cell[order], hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sums, occupied = np.zeros(n * width, U), np.zeros(n * width, bool)
    occupied[cell[starts]] = True
    sums[cell[starts]] = np.add.reduceat(mixed(hashes ^ U(0x5851F42D4C957F2D)), starts)
    sums, occupied = mixed(sums).reshape(n, band.parts, band.cells), occupied.reshape(n, band.parts, band.cells)
    differ = most_differing(size, np.minimum(size * 100 // percent, band.hi), percent)
    full = occupied.sum(axis=2) >= np.minimum(differ, band.tolerance)[:, None] + 1
    must = differ // (band.tolerance + 1) + 1
    so_far = np.cumsum(full, axis=1)
    signs = so_far - full < must[:, None]
    part = mixed(np.arange(band.parts, dtype=U) + U((band.number << 40) + (turn << 32)))
    owners, found = [], []
    for k, subset in enumerate(combinations(range(band.cells), band.cells - band.tolerance)):
        key = np.full((n, band.parts), U(k + 1))
        for j in subset:
            key = mixed(key * U(0xC4CEB9FE1A85EC53) + sums[:, :, j])
        who, which = np.nonzero(signs & occupied[:, :, list(subset)].any(axis=2))
        owners.append(who)
        found.append(mixed(key[who, which] + part[which]))
    return np.concatenate(owners), np.concatenate(found), so_far[:, -1] < must


def signatures(shingles: np.ndarray, begins: np.ndarray, percent: int = LEAST_PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set, and where each set's begin."""
    size = np.diff(begins)
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for band in size_bands(1 << int(max(size.max(initial=0) - 1, 1)).bit_length(), percent):
        sets = np.flatnonzero((size >= band.lo) & (size <= band.hi))
        for turn in range(ROUNDS + 1):
            if not len(sets):
                break
            if turn == ROUNDS:
                owners.append(sets)
                found.append(mixed(np.full(len(sets), (band.number << 40) + (turn << 32) + 0xFFFFFFFF, U)))
                break
            own = size[sets]
            at = np.arange(own.sum()) + np.repeat(begins[:-1][sets] - np.cumsum(own) + own, own)
            who, signed, ran_out = _sign(band, shingles[at], own, turn, percent)
            owners.append(sets[who])
            found.append(signed)
            sets = sets[ran_out]
    owner, signed = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return signed[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


def _set_names(shingles: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set; those of an empty one are 0."""
    names = np.zeros((2, len(begins) - 1), U)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        at = begins[:-1][full]
        names[0, full] = np.add.reduceat(mixed(shingles ^ U(0x5BD1E995)), at)
        names[1, full] = np.add.reduceat(mixed(shingles * U(0x27D4EB2F165667C5)), at)
    return names[0].view(np.int64), names[1].view(np.int64)


_SIGNED = "doc_id long, n long, cls long, cls2 long, signed array<bigint>"


def _signer(width: int, percent: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in each_slice(batch.column(1)):
                shingles, begins = distinct_shingles(words, width)
                signed, at = signatures(shingles, begins, percent)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(begins), pa.int64())]
                columns += [pa.array(x) for x in _set_names(shingles, begins)]
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "cls", "cls2", "signed"])

    return sign


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``bucket, cls``, sorted, those of buckets with several classes, with the first class of the bucket; not that one itself."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate(([last is None or bucket[0] != last[0]], bucket[1:] != bucket[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(cls)), -1))
        hub = np.where(first >= 0, cls[np.maximum(first, 0)], last[1] if last else 0)
        again = np.concatenate(([False], (cls[1:] == cls[:-1]) & ~new[1:]))
        stay = (cls != hub) & ~again
        last = (bucket[-1], hub[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (bucket, cls, hub)], names=["bucket", "cls", "hub"])


#: Where a set is needed: a group ``a, b, c``, the side it is on, the node it stands for.
PLACE = "cls long, a long, b int, c int, side int, node long"
_DEALT = "a long, b int, c int, side int, node long, shingles array<bigint>"


def _sets_at(width: int):
    """From ``text, places`` the set once for each of its places."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(1)
            for lo, hi, words in each_slice(batch.column(0)):
                shingles, begins = distinct_shingles(words, width)
                own = places.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), own.value_lengths().to_numpy())
                flat = own.flatten()
                names = _set_names(shingles, begins)[0]
                # a document of several texts is asked for each of its sets
                fits = np.flatnonzero(flat.field("cls").to_numpy() == names[row])
                size = np.diff(begins)
                for part in np.array_split(fits, max(1, int(size[row[fits]].sum()) >> 20)):
                    rows = row[part]
                    n = size[rows]
                    ends = np.concatenate(([0], np.cumsum(n)))
                    at = np.arange(ends[-1]) + np.repeat(begins[:-1][rows] - ends[:-1], n)
                    taken = flat.take(pa.array(part))
                    columns = [taken.field(c) for c in ("a", "b", "c", "side", "node")]
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(shingles[at].view(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "c", "side", "node", "shingles"])

    return sets


def _near(common, one, two, percent: int):
    return 100 * common >= percent * (one + two - common)


def _each_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with one key ``a, b, c``."""
    for batch in batches:
        if batch.num_rows:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield tuple(key[lo]), batch.slice(lo, hi - lo)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _against_hub(percent: int):
    """Edges between the node of the first row of each group and those of the others that are near it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub, hub_node = None, None, None
        for key, rows in _each_group(batches):
            sets, node = rows.column(5), rows.column(4).to_numpy()
            if key != last:
                last, hub_node = key, int(node[0])
                hub = sets.slice(0, 1).flatten().to_numpy().view(U)
            size = sets.value_lengths().to_numpy().astype(np.int64)
            values = sets.flatten().to_numpy().view(U)
            hit = hub[np.minimum(np.searchsorted(hub, values), len(hub) - 1)] == values
            common = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
            near = np.flatnonzero(_near(common, size, len(hub), percent) & (node != hub_node))
            if len(near):
                yield _edges([(int(node[k]), hub_node) for k in near])

    return compare


def _block_edges(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Edges between nodes of near sets, enough to connect them: side 1 with side 0, or, without that, among side 1."""
    side, node = rows.column("side").to_numpy(), rows.column("node").to_numpy()
    sets = rows.column("shingles").combine_chunks()
    size = sets.value_lengths().to_numpy().astype(np.int64)
    begin = np.cumsum(size) - size
    codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
    flag = np.zeros(len(codes), bool)
    to = side == 0 if (side == 0).any() else np.ones(len(side), bool)
    root = {int(x): int(x) for x in node}
    label = node.copy()
    out = []
    for k in np.flatnonzero(side == 1):
        own = slice(begin[k], begin[k] + size[k])
        other = to & (label != label[k])
        if not other.any():
            continue
        flag[codes[own]] = True
        common = np.add.reduceat(flag[codes], begin, dtype=np.int64)
        flag[codes[own]] = False
        for x in np.unique(label[other & _near(common, size, size[k], percent)]):
            out.append((int(label[k]), int(x)))
            label[label == x] = label[k]
    return out


def _in_blocks(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, known = None, [], set()
        for key, rows in _each_group(batches):
            if key != last and held:
                yield _edges(_block_edges(pa.Table.from_batches(held), percent))
                held, known = [], set()
            last = key
            # a row that repeats another brings its set again
            sets = rows.column(5)
            names = _set_names(sets.flatten().to_numpy().view(U), np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy()))))[0]
            of = list(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), names.tolist()))
            new = []
            for row in of:
                new.append(row not in known)
                known.add(row)
            held.append(rows.filter(pa.array(new)))
        if held:
            yield _edges(_block_edges(pa.Table.from_batches(held), percent))

    return compare


class _Join:
    """One run of the join over ``doc_id, text``."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def classes(self) -> None:
        """``rows``: ``doc_id, n, rep`` of each row; ``kinds``: ``cls, n, rep`` of each set; ``met``: classes that share a bucket."""
        folder = new_folder(self.spark, "signed")
        signed = written(self.docs.mapInArrow(_signer(self.width, self.percent), _SIGNED), folder)
        by = ["n", "cls", "cls2"]
        kinds = signed.where("doc_id is not null and n > 0").groupBy(*by).agg(F.min("doc_id").alias("rep"))
        self.kinds = written(kinds)
        rows = signed.drop("signed").join(self.kinds, by, "left")
        self.rows = written(rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")))
        first = ids_for_join(self.kinds.select(F.col("rep").alias("doc_id"), *by))
        buckets = signed.join(first, ["doc_id", *by], "left_semi").select(F.explode("signed").alias("bucket"), "cls")
        buckets = buckets.repartition("bucket").sortWithinPartitions("bucket", "cls")
        self.met = written(buckets.mapInArrow(_met, "bucket long, cls long, hub long"))
        remove_folder(self.spark, folder)

    def dealt(self, places: DataFrame, n: int) -> DataFrame:
        """The sets at their ``n`` places, each group sorted and whole in a task."""
        places = places.join(self.kinds.select("cls", "rep"), "cls")
        by_doc = places.groupBy("rep").agg(F.collect_list(F.struct("cls", "a", "b", "c", "side", "node")).alias("places"))
        if n <= PLACES_TO_SEND:
            by_doc = F.broadcast(by_doc)
        texts = self.docs.join(by_doc, self.docs["doc_id"] == by_doc["rep"]).select("text", "places")
        key = ["a", "b", "c"]
        return texts.mapInArrow(_sets_at(self.width), _DEALT).repartition(*key).sortWithinPartitions(*key, "side")

    def hub_edges(self, pairs: DataFrame) -> DataFrame:
        """Edges of nodes from distinct ``hub, cls``; a hub with many members is compared in several tasks."""
        salts = F.greatest(F.lit(1), F.ceil(F.count("*") / HUB_MEMBERS)).cast("int").alias("salts")
        pairs = written(pairs)
        hubs = pairs.groupBy("hub").agg(salts)
        zero = F.lit(0).alias("c")
        part = F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("b")
        members = pairs.join(hubs, "hub").select("cls", F.col("hub").alias("a"), part, zero, F.lit(1).alias("side"))
        every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("b")
        own = hubs.select(F.col("hub").alias("cls"), F.col("hub").alias("a"), every, zero, F.lit(0).alias("side"))
        places = members.unionByName(own).join(self.kinds.select("cls", F.col("rep").alias("node")), "cls")
        # a hub has as many places as salts, no more than members
        return written(self.dealt(places, 2 * pairs.count()).mapInArrow(_against_hub(self.percent), "a long, b long"))

    def near_labels(self, edges: DataFrame) -> DataFrame:
        """``node, comp``: of each node with edges the least node within four steps, enough to tell most that are connected."""
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.join(least.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("m"))
        near = near.select(F.col("a").alias("node"), F.least("a", "m").alias("at"))
        return written(near.join(near.select(F.col("node").alias("at"), F.col("at").alias("comp")), "at").select("node", "comp"))

    def components(self, edges: DataFrame) -> DataFrame:
        """``node, comp`` of all nodes with edges: what near labels leave apart is connected by the steps of ``connected``."""
        labels = self.near_labels(edges)
        end = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        apart = edges.join(end("a"), "a").join(end("b"), "b").where("a_comp <> b_comp")
        above = connected(apart.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
        above = above.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        return labels.join(above, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"))

    def members(self, rest: DataFrame, labels: DataFrame) -> DataFrame:
        """``bucket, cls, n, comp``."""
        own = self.kinds.select("cls", "n", F.col("rep").alias("node"))
        own = own.join(labels, "node", "left").select("cls", "n", F.coalesce("comp", "node").alias("comp"))
        return rest.join(own, "cls").select("bucket", "cls", "n", "comp")

    def edges(self, sure: DataFrame) -> DataFrame:
        """Edges ``a, b`` of nodes that connect all that are linked, from the first ``sure`` ones."""
        named = self.kinds.select("cls", "n")
        pairs = self.met.select("hub", "cls").distinct().join(named, "cls")
        pairs = pairs.join(named.select(F.col("cls").alias("hub"), F.col("n").alias("hub_n")), "hub")
        edges = sure.unionByName(self.hub_edges(pairs.where(self._sizes("n", "hub_n")).select("hub", "cls")))
        rest = self.met.select("bucket", "cls")
        for turn in range(1, HUBS + 1):
            rest = self.members(rest, self.near_labels(edges))
            open_ = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cls").alias("hub"))
            open_ = open_.where("lo <> hi").select("bucket", "hub")
            rest = written(rest.join(open_, "bucket"))
            if rest.isEmpty():
                return edges
            groups, blocks = self.groups(rest)
            moved, places = blocks.agg(F.sum("copies"), F.sum("places")).first()
            if turn == HUBS or moved <= COPIES * groups.agg(F.sum("n")).first()[0]:
                return edges.unionByName(self.block_edges(groups, blocks, places))
            hub = rest.where("cls = hub").select("bucket", F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))
            pairs = rest.where("cls <> hub").join(hub, "bucket").where("comp <> hub_comp").where(self._sizes("n", "hub_n"))
            edges = edges.unionByName(self.hub_edges(pairs.select("hub", "cls").distinct()))
            rest = rest.where("cls <> hub").select("bucket", "cls")
        return edges

    def _sizes(self, a: str, b: str) -> str:
        return f"100L * least({a}, {b}) >= {self.percent}L * greatest({a}, {b})"

    def blocks(self, rows: DataFrame, *by: str) -> DataFrame:
        """For each group of ``bucket, cls, n, comp``: its largest component, blocks of that and of the others, shingles and sets to move."""
        by = [*by, "bucket"]
        sums = rows.groupBy(*by, "comp").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
        large = sums.groupBy(*by).agg(F.max(F.struct("sets", "comp"))["comp"].alias("large"), (F.count("*") - 1).alias("comps"))
        sums = sums.join(large, by).withColumn("is_large", F.col("comp") == F.col("large"))
        of = lambda c, large: F.sum(F.when(F.col("is_large") == large, F.col(c)))
        number = lambda large: F.ceil(F.greatest(of("shingles", large) / BLOCK_SHINGLES, of("sets", large) / BLOCK_SETS)).cast("int")
        sizes = [of(c, large).alias(f"{c}_{large}") for c in ("shingles", "sets") for large in (True, False)]
        out = sums.groupBy(*by, "large", "comps").agg(number(True).alias("many"), number(False).alias("few"), *sizes)
        among = F.when(F.col("comps") > 1, F.col("few")).otherwise(0)
        moved = [
            (F.col(f"{c}_True") * F.col("few") + F.col(f"{c}_False") * (F.col("many") + among)).alias(name)
            for c, name in (("shingles", "copies"), ("sets", "places"))
        ]
        return out.select(*by, "large", "comps", "many", "few", *moved)

    def groups(self, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What is to be compared, ``bucket, cls, n, comp``, and its blocks.

        Near copies meet in many buckets, each time others of them.  A bucket belongs to the family of the least
        class among those that its members meet anywhere, and a small family needs its sets only once; of a
        family and its buckets that counts which moves less.
        """
        family = F.min("family").alias("family")
        of_bucket = rest.groupBy("bucket").agg(F.min("cls").alias("family"))
        of_cls = rest.join(of_bucket, "bucket").groupBy("cls").agg(family)
        of_bucket = rest.join(of_cls, "cls").groupBy("bucket").agg(family)
        apart = written(rest.select("bucket", "cls", "n", "comp").join(of_bucket, "bucket").withColumn("whole", F.lit(False)))
        whole = apart.select(F.col("family").alias("bucket"), "cls", "n", "comp", "family", F.lit(True).alias("whole")).distinct()
        rows = written(apart.unionByName(whole))
        blocks = written(self.blocks(rows, "family", "whole"))
        copies = [F.coalesce(F.sum(F.when(F.col("whole") == w, F.col("copies"))), F.lit(0)) for w in (True, False)]
        better = blocks.groupBy("family").agg((copies[0] <= copies[1]).alias("whole"))
        key = ["family", "whole"]
        return rows.join(better, key, "left_semi").drop(*key), written(blocks.join(better, key, "left_semi").drop(*key))

    def block_edges(self, rows: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
        """Edges of components between the members of each group, compared in blocks."""
        rows = rows.select("bucket", "cls", "comp").join(blocks, "bucket")
        is_large = F.col("comp") == F.col("large")
        mix = F.xxhash64("cls")
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        common = [F.col("cls"), F.col("bucket").alias("a")]
        node = F.col("comp").alias("node")
        most = rows.where(is_large).withColumn("b", F.pmod(mix, F.col("many")).cast("int"))
        most = most.select(*common, "b", F.explode(upto("few")).alias("c"), F.lit(0).alias("side"), node)
        others = rows.where(~is_large).withColumn("own", F.pmod(mix, F.col("few")).cast("int"))
        with_most = others.select(*common, F.explode(upto("many")).alias("b"), F.col("own").alias("c"), F.lit(1).alias("side"), node)
        # blocks of the others with each other: numbered from -1 downwards
        among = others.where("comps > 1").select("*", F.explode(upto("few")).alias("other"))
        one, two = F.least("own", "other"), F.greatest("own", "other")
        side = F.when((F.col("own") < F.col("other")), 0).otherwise(1).alias("side")
        among = among.select(*common, (F.lit(-1) - one).alias("b"), two.alias("c"), side, node)
        places = most.unionByName(with_most).unionByName(among)
        return written(self.dealt(places, n).mapInArrow(_in_blocks(self.percent), "a long, b long"))

    def result(self) -> DataFrame:
        self.classes()
        of_doc = self.rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
        of_doc = written(of_doc)
        several = of_doc.where("lo <> hi").select("doc_id", "lo")
        sure = self.rows.where("rep is not null").join(several, "doc_id").select(F.col("rep").alias("a"), F.col("lo").alias("b"))
        labels = self.components(self.edges(sure)).select(F.col("node").alias("lo"), "comp")
        out = self.rows.select("doc_id", F.col("n").alias("n_shingles")).join(of_doc.select("doc_id", "lo"), "doc_id", "left")
        out = out.join(labels, "lo", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("comp", "lo", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = LEAST_PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: the smallest document that can be reached by links."""
    return _Join(docs, width, percent).result()
