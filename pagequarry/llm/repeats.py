"""Removing repeated passages: suffix arrays in shards, built by induced sorting.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a
smaller document, or earlier in the same one) is removed.  All strings are judged
on the texts as they came in; matches never cross documents.

A shard must hold all equal strings, and no more.  Of the hashes of the ``GRAM``-byte
substrings in a string the least one, the first of equals, is the string's sample;
equal strings have equal samples.  Neighbouring strings with one sample make a
stretch.  Only stretches whose sample also occurs elsewhere can hold repeats:

1. count the samples of all texts; a filter of fixed size remembers those that occur
   in two places, and no stretch without a repeated sample goes on;
2. of stretches with the same bytes all but the first are covered as a whole; they
   run through in order, however many there are;
3. different stretches with one sample are cut out of the texts and meet in a shard.
   Its suffix array is built by induced sorting; where the common prefix with the
   neighbour has ``LENGTH`` bytes, all but the first place are covered.  A sample with
   more than ``SHARD_BYTES`` of different stretches is in no shard: its strings meet
   one by one, by their hashes, and run through in order;
4. merge the covered ranges of each text.

Samples and equal bytes are told by 64-bit hashes, strings in shards by prefix hashes
of 64 bits.

Defined cases: a null text is empty; shorter texts than ``LENGTH`` lose nothing;
rows without ``doc_id`` come before all others; rows that share a ``doc_id`` are
ordered by a hash of their texts, and if these agree too they are one document, of
which each row gets the result; an empty table gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.suffixes import Prefixes, permuted_common_prefixes, suffix_array
from pagequarry.llm.tables import ids_for_join
from pagequarry.llm.words import U, _powers, mixed, slices, utf8
from pagequarry.sources.lineage import written

LENGTH = 100
GRAM = 24
#: Bytes of a shard's text that are sorted at once; strings of samples with more are told by their hashes.
SHARD_BYTES = 1 << 21
#: Longer texts are taken in parts that overlap by a string.
PART_BYTES = 1 << 22
_POSITION = 23
_BYTES = mixed(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))


def _parts(starts: np.ndarray) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Rows, first byte in the row, and byte ranges to look at together."""
    for lo, hi in slices(starts):
        if hi - lo > 1 or starts[hi] - starts[lo] <= PART_BYTES:
            yield list(range(lo, hi)), [0] * (hi - lo), starts[lo : hi + 1]
            continue
        at = int(starts[lo])
        while at < starts[hi]:
            end = min(at + PART_BYTES, int(starts[hi]))
            yield [lo], [at - int(starts[lo])], np.array([at, end])
            at = end - LENGTH + 1 if end < starts[hi] else end


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    blocks = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def samples(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of some texts: row, first string's place in the text, number of strings, sample."""
    n, empty = len(data), np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, np.zeros(0, U)
    power, inverse = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTES[data] * power[:n], dtype=U)))
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    keys = (grams >> U(_POSITION) << U(_POSITION)) | np.arange(len(grams), dtype=U)
    least = (_window_minima(keys, LENGTH - GRAM + 1) & U((1 << _POSITION) - 1)).astype(np.int64)
    # strings of one text lie together: a stretch ends where the sample changes, or with the text's last string
    room = np.maximum(np.diff(starts) - LENGTH + 1, 0)
    rows = np.flatnonzero(room)
    if not len(rows):
        return empty, empty, empty, np.zeros(0, U)
    fresh = np.concatenate(([True], least[1:] != least[:-1]))
    fresh[starts[rows]] = True
    past = starts[rows] + room[rows]
    fresh[past[past < len(fresh)]] = True
    new = np.flatnonzero(fresh)
    count = np.diff(np.append(new, len(fresh)))
    row = np.searchsorted(starts, new, "right") - 1
    keep = np.flatnonzero(new < starts[row] + room[row])
    new, row, count = new[keep], row[keep], count[keep]
    return row, new - starts[row], count, grams[least[new]]


def _each_sampled(column, hashed: bool = True) -> Iterator[tuple]:
    """Row, place, strings, sample and a hash of the bytes (if wanted) of all stretches, a part of the texts at a time."""
    data, starts = utf8(column)
    for rows, offsets, ends in _parts(starts):
        part, at_0 = data[ends[0] : ends[-1]], ends - ends[0]
        row, at, count, sample = samples(part, at_0)
        same = Prefixes(part)(at_0[row] + at, count + (LENGTH - 1)) if hashed and len(row) else sample
        yield np.array(rows, np.int64)[row], at + np.array(offsets, np.int64)[row], count, sample, same


def _only_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, sample, _ in _each_sampled(batch.column(0), hashed=False):
            yield pa.RecordBatch.from_arrays([pa.array(sample.view(np.int64))], names=["sample"])


_SAMPLED = "doc long, fp long, at long, strings int, sample long, same long"
#: Bits of the filter that every executor gets: 8 MB, whatever the corpus.
_FILTER_BITS = 26


def _sampled(sent):
    """Stretches whose sample passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for row, at, count, sample, same in _each_sampled(batch.column(2)):
                slot = (sample & U((1 << _FILTER_BITS) - 1)).astype(np.int64)
                keep = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                mine = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(mine),
                        batch.column(1).take(mine),
                        pa.array(at[keep]),
                        pa.array(count[keep].astype(np.int32)),
                        pa.array(sample[keep].view(np.int64)),
                        pa.array(same[keep].view(np.int64)),
                    ],
                    names=["doc", "fp", "at", "strings", "sample", "same"],
                )

    return run


def _repeated_bits(stretches: DataFrame) -> np.ndarray:
    """A bit for the low bits of each sample that occurs twice: what has none need not be looked at again."""
    repeated = stretches.groupBy("sample").count().where("count > 1")
    slot = F.col("sample").bitwiseAND(F.lit((1 << _FILTER_BITS) - 1))
    part = F.shiftright(slot, 15).alias("part")
    rows = repeated.groupBy(part).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    for r in rows:
        out[r.part << 12 : (r.part + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc, fp, text``: an order of the documents, and their text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("fp"), text.alias("text"))


_JUDGED = "doc long, fp long, at long, strings int, sample long, later boolean"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by sample, bytes, document and place.

    The first of each kind of stretch stays for the shard, if its sample has another
    kind; all others are covered whole.  Only one row is held back, until it is
    known whether another kind follows, so a sample of any size runs through.
    """
    names = ["doc", "fp", "at", "strings", "sample"]
    held, last, last_first = None, None, False

    def out(rows: pa.RecordBatch, later: np.ndarray) -> pa.RecordBatch:
        rows = rows.select(names)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(later)], names=[*names, "later"])

    for batch in batches:
        if not batch.num_rows:
            continue
        sample, same = (batch.column(n).to_numpy() for n in ("sample", "same"))
        new_sample = np.concatenate(([last is None or sample[0] != last[0]], sample[1:] != sample[:-1]))
        first = new_sample | np.concatenate(([last is None or same[0] != last[1]], same[1:] != same[:-1]))
        # copies of a row are one place: those of a first row are no later ones
        place = np.stack([batch.column(n).to_numpy() for n in ("doc", "fp", "at")], axis=1)
        copy = ~first & np.concatenate(([last is not None and (place[0] == last[2]).all()], (place[1:] == place[:-1]).all(axis=1)))
        origin = np.maximum.accumulate(np.where(copy, -1, np.arange(len(copy))))
        of_first = np.where(origin < 0, last_first, first[origin])
        later = ~first & ~(copy & of_first)
        last_first = bool(of_first[-1])
        yield out(batch.filter(pa.array(later)), np.ones(int(later.sum()), bool))
        at = np.flatnonzero(first)
        if len(at):
            opens = new_sample[at]
            if held is not None and not opens[0]:
                yield out(held, np.zeros(1, bool))
            follows = np.append(~opens[1:], False)
            # a kind counts if it is not the first of its sample, or another follows
            needed = ~opens | follows
            yield out(batch.take(pa.array(at[needed])), np.zeros(int(needed.sum()), bool))
            held = None if needed[-1] else batch.slice(int(at[-1]), 1)
        last = (sample[-1], same[-1], place[-1])


_STRETCH = "doc long, fp long, at long, sample long, bytes binary"


def _found_bytes(batch: pa.RecordBatch, large: np.ndarray, wanted: bool) -> Iterator[tuple]:
    """Row, place, strings, sample and bytes of listed stretches, of ``large`` samples or of the others, some at a time."""
    data, starts = utf8(batch.column(2))
    lists = batch.column(3)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    found = lists.flatten()
    at, strings, sample = (found.field(i).to_numpy() for i in range(3))
    keep = np.flatnonzero(np.isin(sample, large) == wanted)
    owner, at, strings, sample = owner[keep], at[keep], strings[keep].astype(np.int64), sample[keep]
    first = starts[owner] + at
    length = strings + LENGTH - 1
    for lo in range(0, len(owner), 8192):
        part = slice(lo, lo + 8192)
        blobs = [data[a : a + n].tobytes() for a, n in zip(first[part].tolist(), length[part].tolist())]
        yield owner[part], at[part], strings[part], sample[part], blobs


def _cut(sent):
    """The bytes of the stretches that are listed beside each text for a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, at, _, sample, blobs in _found_bytes(batch, sent.value, False):
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(at), pa.array(sample), pa.array(blobs, pa.binary())],
                    names=["doc", "fp", "at", "sample", "bytes"],
                )

    return run


_STRING = "doc long, fp long, at long, string long"


def _single_strings(sent):
    """Each string, as a hash, of the listed stretches whose samples are too large for a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, at, strings, _, blobs in _found_bytes(batch, sent.value, True):
                begins = np.cumsum(strings + LENGTH - 1) - (strings + LENGTH - 1)
                inside = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
                hashes = mixed(Prefixes(np.frombuffer(b"".join(blobs), np.uint8))(np.repeat(begins, strings) + inside, LENGTH))
                own = pa.array(np.repeat(owner, strings))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(np.repeat(at, strings) + inside), pa.array(hashes.view(np.int64))],
                    names=["doc", "fp", "at", "string"],
                )

    return run


def _later_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by string, document and place; all places of a string but the first are covered."""
    string, place = None, None  # of the last first one
    for batch in batches:
        if not batch.num_rows:
            continue
        places = np.stack([batch.column(n).to_numpy() for n in ("doc", "fp", "at")], axis=1)
        strings = batch.column("string").to_numpy()
        new = np.concatenate(([string is None or strings[0] != string], strings[1:] != strings[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        of_first = places[np.maximum(first, 0)]
        if place is not None:
            of_first[first < 0] = place
        # copies of a row are one place
        later = pa.array((places != of_first).any(axis=1))
        string, place = strings[-1], of_first[-1]
        some = batch.select(["doc", "fp", "at"]).filter(later)
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(some.num_rows, LENGTH))], names=["doc", "fp", "at", "length"])


_COVERED = "doc long, fp long, at long, length long"


def _ranges(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ascending integers: first and count."""
    new = np.flatnonzero(np.concatenate(([True], np.diff(places) != 1)))
    return places[new], np.diff(np.append(new, len(places)))


def covered_in_shard(doc: np.ndarray, fp: np.ndarray, at: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered ranges of some stretches: index of the stretch, first byte in the document, length."""
    size = np.array([len(b) for b in blobs])
    begins = np.concatenate(([0], np.cumsum(size + 1)))
    # byte values are moved up, 0 stands between the stretches
    text = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8).astype(np.uint16) + 1
    text[begins[1:] - 1] = 0
    owner = np.repeat(np.arange(len(blobs)), size + 1)
    whole = np.arange(len(text)) + LENGTH < begins[owner + 1]
    order = suffix_array(text)
    places = order[whole[order]]
    common = permuted_common_prefixes(places, Prefixes(text))
    group = np.cumsum(common < LENGTH)
    mine = owner[places]
    start = at[mine] + places - begins[mine]
    # the first of each group of equal strings, by document and place
    by = np.lexsort((start, fp[mine], doc[mine], group))
    first = np.concatenate(([True], np.diff(group[by]) != 0))
    # copies of a row are one place
    origin = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    copy = (doc[mine[by]] == doc[mine[origin]]) & (fp[mine[by]] == fp[mine[origin]]) & (start[by] == start[origin])
    again = np.sort(places[by[~copy]])
    if not len(again):
        return (np.zeros(0, np.int64),) * 3
    begin, count = _ranges(again)
    whose = owner[begin]
    return whose, at[whose] + begin - begins[whose], count + LENGTH - 1


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by sample; whole samples are gathered up to the size of a shard."""
    held: list[pa.RecordBatch] = []
    held_bytes, last = 0, None

    def sort(rows: pa.Table) -> pa.RecordBatch:
        doc, fp, at = (rows.column(n).to_numpy() for n in ("doc", "fp", "at"))
        whose, first, length = covered_in_shard(doc, fp, at, rows.column("bytes").to_pylist())
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[whose]), pa.array(fp[whose]), pa.array(first), pa.array(length)], names=["doc", "fp", "at", "length"]
        )

    for batch in batches:
        sample = batch.column("sample").to_numpy()
        size = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())))
        if not batch.num_rows:
            continue
        new = np.flatnonzero(np.concatenate(([sample[0] != last], np.diff(sample) != 0)))
        lo = 0
        for k in new:
            if held_bytes + size[k] - size[lo] >= SHARD_BYTES:
                if k > lo:
                    held.append(batch.slice(lo, k - lo))
                if held:
                    yield sort(pa.Table.from_batches(held))
                held, held_bytes, lo = [], 0, int(k)
        held.append(batch.slice(lo))
        held_bytes += int(size[-1] - size[lo])
        last = sample[-1]
    if held:
        yield sort(pa.Table.from_batches(held))


def covered(docs: DataFrame) -> DataFrame:
    """``doc, fp, at, length``: ranges of bytes to remove, with overlaps; ``doc, fp`` as in ``_keyed``."""
    keyed = _keyed(docs)
    bits = _repeated_bits(keyed.select("text").mapInArrow(_only_samples, "sample long"))
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    stretches = keyed.mapInArrow(_sampled(sent), _SAMPLED)
    stretches = stretches.repartition("sample").sortWithinPartitions("sample", "same", "doc", "fp", "at")
    judged = stretches.mapInArrow(_judged, _JUDGED)
    # gathered by document, as both the cut and the result need them
    here = F.struct("at", "strings", "sample")
    lists = judged.groupBy("doc", "fp").agg(
        F.collect_list(F.when(F.col("later"), F.struct("at", "strings"))).alias("later"),
        F.collect_list(F.when(~F.col("later"), here)).alias("found"),
    )
    lists = written(lists)
    needed = lists.where("size(found) > 0").select("doc", "fp", "found")
    ids = ids_for_join(needed.select("doc", "fp"))
    texts = keyed.join(ids, ["doc", "fp"], "left_semi")
    texts = texts.join(needed, ["doc", "fp"]).select("doc", "fp", "text", "found")
    # there are at most as many large samples as shards
    size = needed.select(F.explode("found").alias("f")).groupBy("f.sample").agg(F.sum(F.col("f.strings") + (LENGTH - 1)).alias("bytes"))
    large = np.array([r.sample for r in size.where(F.col("bytes") > SHARD_BYTES).select("sample").collect()], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(large)
    shards = texts.mapInArrow(_cut(sent), _STRETCH)
    shards = shards.repartition("sample").sortWithinPartitions("sample")
    sorted_ = shards.mapInArrow(_sorted_shards, _COVERED)
    later = lists.select("doc", "fp", F.explode("later").alias("r"))
    later = later.select("doc", "fp", "r.at", (F.col("r.strings") + (LENGTH - 1)).cast("long").alias("length"))
    out = later.unionByName(sorted_)
    if len(large):
        strings = texts.mapInArrow(_single_strings(sent), _STRING)
        strings = strings.repartition("string").sortWithinPartitions("string", "doc", "fp", "at")
        out = out.unionByName(strings.mapInArrow(_later_strings, _COVERED))
    return out


def _merged(at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal disjoint ones: begins and ends, ascending."""
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate((at + length)[order])
    new = np.flatnonzero(np.concatenate(([True], at[1:] > end[:-1])))
    return at[new], end[np.append(new[1:] - 1, len(at) - 1)]


def _kept_parts(text: bytes, ranges: list | None) -> tuple[list[bytes], int, int]:
    """What stays, bytes removed, maximal ranges removed."""
    if not ranges:
        return [text], 0, 0
    begin, end = _merged(np.array([r["at"] for r in ranges]), np.array([r["length"] for r in ranges]))
    parts = [text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)])]
    return parts, int((end - begin).sum()), len(begin)


_RESULT = "doc long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out: list[tuple] = []
                for doc, no_id, text, ranges in zip(*(some.column(i).to_pylist() for i in range(4))):
                    text = text.encode()
                    parts, gone, spans = _kept_parts(text, ranges)
                    digest = hashlib.sha256()
                    for p in parts:
                        digest.update(p)
                    out.append((doc, no_id, len(text), gone, spans, digest.hexdigest(), b"".join(parts) if with_text else None))
                columns = list(zip(*out)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()),
                        pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.string()),
                        pa.array(columns[6], pa.binary()),
                    ],
                    names=[c.split()[0] for c in _RESULT.split(",")],
                )

    return run


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for each row; ``kept``: the bytes that stay."""
    ranges = covered(docs).groupBy("doc", "fp").agg(F.collect_list(F.struct("at", "length")).alias("ranges"))
    ranges = written(ranges)
    keyed = _keyed(docs).withColumn("no_id", F.col("doc") == -(1 << 63))
    touched = ids_for_join(ranges.select("doc", "fp"))
    run = _removed(with_text)
    some = keyed.join(touched, ["doc", "fp"], "left_semi").join(ranges, ["doc", "fp"])
    rest = keyed.join(touched, ["doc", "fp"], "left_anti").withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType))
    rows = some.select("doc", "no_id", "text", "ranges").unionByName(rest.select("doc", "no_id", "text", "ranges"))
    rows = rows.mapInArrow(run, _RESULT)
    doc_id = F.when(~F.col("no_id"), F.col("doc")).alias("doc_id")
    return rows.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
