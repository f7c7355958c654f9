"""Token ids in files: one concatenated id array per segment, document boundaries in Elias-Fano code.

Documents are dealt out by ranges of ``doc_id``, sorted, encoded, and written as
segments of about ``segment_ids`` ids.  A segment is one row of a Parquet table,
so Spark's writer commits it and a lost executor repeats its own part only:

========== =====================================================================
``part``   number of the range, ascending with ``doc_id``
``seg``    number of the segment in its range
``n_ids``  ids in it
``doc_ids``documents in it, in order
``width``  bytes of an id: 2 if the vocabulary has at most 65,536 ids, else 4
``ids``    the ids, little-endian
``low_bits``, ``low``, ``high``  boundaries (see ``EliasFano``)
========== =====================================================================

Every document ends with the end id.  Defined cases: a null or empty text has the
end id only; rows without ``doc_id`` come first; rows that share one are in the
order of their texts; an empty table gives an empty file and no rows.

A text that spells a special token, such as ``<|endoftext|>``, gets the id of that token,
as the library has it; documents are told apart by the boundaries, not by an id.  Other
columns are not looked at; a text is encoded whole, however long it is.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.llm.words import slices, utf8
from pagequarry.sources.lineage import new_folder, written

SEGMENT_IDS = 1 << 20
#: Bytes of encoded pieces a worker remembers, and what one takes besides its text and ids.
MEMORY_BYTES = 1 << 26
PIECE_BYTES = 180
#: Longer pieces, in bytes, are not remembered.
LONGEST_KNOWN = 256
#: Bytes of text that a worker looks at together.
TEXT_BYTES = 1 << 22

FILE_SCHEMA = (
    "part int, seg long, n_ids long, doc_ids array<bigint>, width int, ids binary, low_bits int, low binary, high binary"
)


class EliasFano:
    """An ascending sequence of n numbers below u in about n * (2 + log2(u / n)) bits.

    The low bits of each number are packed; the rest is written in unary: number
    i sets bit ``(value >> low_bits) + i`` of ``high``.  ``select(i)`` looks up the
    i-th set bit through a count of set bits per 64-bit word.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high + b"\0" * (-len(high) % 8), np.uint8)
        per_word = np.bitwise_count(self.high.view("<u8")).astype(np.int64)
        #: Set bits before each word.
        self.rank = np.concatenate(([0], np.cumsum(per_word)))

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
        """``(low_bits, low, high)``."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return 0, b"", b""
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        return low_bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes()

    def select(self, wanted) -> np.ndarray:
        """The numbers at these indexes."""
        i = np.asarray(wanted, np.int64)
        word = np.searchsorted(self.rank, i, "right") - 1
        bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1, bitorder="little")
        inside = i - self.rank[word]
        bit = np.argmax(np.cumsum(bits, axis=1, dtype=np.int64) == (inside + 1)[:, None], axis=1)
        value = (word * 64 + bit - i) << self.low_bits
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            value |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return value


#: Classes of characters; DOUBT is what some take for white space, OTHER what is certainly none.
DOUBT, LETTER, DIGIT, MARK, QUOTE, OTHER, SPACE, WHITE = range(8)


def _kinds() -> np.ndarray:
    """The class of each code point, as every version of Unicode has it; letters are Latin ones only."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    kinds[:128] = [LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK for c in map(chr, range(128))]
    kinds[0xC0:0x250] = LETTER
    kinds[[0xD7, 0xF7]] = OTHER
    kinds[[i for i in range(0x10000) if chr(i).isspace()] + [0x180E, 0x200B]] = DOUBT
    kinds[9:14], kinds[ord(" ")], kinds[ord("'")] = WHITE, SPACE, QUOTE
    return kinds


def _between() -> np.ndarray:
    """Whether a piece begins between two classes, whatever stands around; at ``8 * first + second``.

    An apostrophe takes letters along, marks take apostrophes along, and a space goes with what follows it.
    """
    cut = np.zeros((8, 8), bool)
    cut[LETTER : OTHER + 1, SPACE:] = cut[WHITE, LETTER : OTHER + 1] = True
    cut[LETTER, [DIGIT, MARK, QUOTE]] = cut[DIGIT, [LETTER, MARK, QUOTE]] = True
    cut[MARK, [LETTER, DIGIT]] = cut[QUOTE, DIGIT] = True
    return cut.ravel()


_KINDS, _BETWEEN = _kinds(), _between()


def _char_kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    kinds = _KINDS[:256][data]
    leads = np.flatnonzero(data >= 0xC0)
    for size, least, below in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        at = leads[(data[leads] >= least) & (data[leads] < below)]
        point = data[at].astype(np.int64) - least
        for k in range(1, size):
            point = point << 6 | data[at + k] & 0x3F
        for k in range(size):
            kinds[at + k] = _KINDS[point]
    return kinds


def _piece_starts(data: np.ndarray, bounds: np.ndarray, whole: list[tuple[int, int]]) -> np.ndarray:
    """Where the pattern of byte-level BPE certainly begins a new match in the texts between ``bounds``.

    What lies in ``whole`` is a piece, and cuts the text around it.  Of white space before something else, the last
    character stands apart.
    """
    kinds = _char_kinds(data)
    for a, b in whole:
        kinds[a:b] = OTHER
    bounds = np.unique(np.append(bounds, np.array(whole, np.int64).ravel()))
    before_solid = np.zeros(len(data), bool)
    before_solid[:-1] = (kinds[1:] >= LETTER) & (kinds[1:] <= OTHER)
    before_solid[bounds[1:] - 1] = False
    cut = (kinds >= SPACE) & before_solid
    cut[1:] |= _BETWEEN[kinds[:-1] << 3 | kinds[1:]]
    cut[bounds[:-1]] = True
    return np.flatnonzero(cut)


def _between_bytes(body: pa.Buffer | None, at: np.ndarray) -> list[bytes]:
    """The bytes between neighbouring numbers of ``at``."""
    body, at = body.to_pybytes() if body else b"", at.tolist()
    return [body[a:b] for a, b in zip(at, at[1:])]


class Encoder:
    """Ids of texts as little-endian bytes; remembers the pieces it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        #: Ids of pieces: those met since the memory was half full, and those met before.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.known_bytes = 0
        # ids whose text begins with a space, in the vocabulary's spelling
        self.opens = np.zeros(size, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        line_end = array(self.code, self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.ends_line = np.zeros(size, bool)
        self.ends_line[line_end] = True
        spec = json.loads(self.tokenizer.to_str())
        cut, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        #: Whether texts are cut by the usual pattern, and around the added tokens as they are spelled.
        self.parts = (
            (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
            and not any(spec[k] for k in ("normalizer", "truncation", "padding"))
            and len(line_end) == 1
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
            and all(x.split() == [x] for x in names)
        )
        self.added = re.compile(b"|".join(re.escape(x.encode()) for x in names)) if names else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in encoded]

    def _joined(self, pieces: list[bytes], before: bytes, first: np.ndarray, skip: int) -> list[bytes]:
        """Encode pieces, with ``before`` between them: many as one text, cut at the ids in ``first``, of which ``skip`` go.

        If a text is not cut into as many parts, its pieces are encoded one by one.
        """
        width, out = self.dtype.itemsize, []
        parts = [pieces[i : i + 256] for i in range(0, len(pieces), 256)]
        for part, blob in zip(parts, self._ids([(before + before.join(part)).decode() for part in parts])):
            at = np.flatnonzero(first[np.frombuffer(blob, self.dtype)])
            if len(at) == len(part) and at[0] == 0:
                ends = [*(at[1:] * width).tolist(), len(blob)]
                out += [blob[a:b] for a, b in zip(((at + skip) * width).tolist(), ends)]
            else:
                out += self._ids([x.decode() for x in part])
        return out

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new pieces; those without white space, but for a space in front, are encoded many at a time."""
        spaced, bare, single = [], [], []
        for x in pieces:
            text = x.decode()
            words = text.split() if self.parts else ()
            rest = len(text) - len(words[0]) if len(words) == 1 else 2
            (bare if not rest else spaced if rest == 1 and text[0] == " " else single).append(x)
        out = dict(zip(single, self._ids([x.decode() for x in single])))
        out.update(zip(bare, self._joined(bare, b"\n", self.ends_line, 1)))
        out.update(zip(spaced, self._joined(spaced, b"", self.opens, 0)))
        return out

    def _looked_up(self, pieces: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        missing = [x for x, ids in zip(pieces, found) if ids is None]
        if not missing:
            return found
        fresh = {x: ids for x, ids in zip(missing, map(self.older.get, missing)) if ids is not None}
        fresh |= self.learn([x for x in missing if x not in fresh])
        found = [fresh[x] if ids is None else ids for x, ids in zip(pieces, found)]
        if max(map(len, missing)) > LONGEST_KNOWN:
            fresh = {x: ids for x, ids in fresh.items() if len(x) <= LONGEST_KNOWN}
        self.known |= fresh
        self.known_bytes += len(fresh) * PIECE_BYTES + sum(map(len, fresh)) + sum(map(len, fresh.values()))
        if self.known_bytes > MEMORY_BYTES // 2:
            # what is still used comes back from there
            self.older, self.known, self.known_bytes = self.known, {}, 0
        return found

    def _whole(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Where texts spell an added token."""
        body = data.tobytes()
        if not self.added or not self.added.search(body):
            return []
        rows = zip(bounds[:-1].tolist(), bounds[1:].tolist())
        return [m.span() for a, b in rows for m in self.added.finditer(body, a, b)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text; equal pieces are looked up once."""
        data, bounds = utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if not len(data):
            return [b""] * (len(bounds) - 1)
        if self.parts:
            starts = _piece_starts(data, bounds, self._whole(data, bounds))
        else:
            starts = bounds[:-1][np.diff(bounds) > 0]
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        _, ends, body = coded.dictionary.buffers()
        different = _between_bytes(body, np.frombuffer(ends, np.int32)[: len(coded.dictionary) + 1])
        ids = pa.array(self._looked_up(different), pa.large_binary()).take(coded.indices)
        _, ends, body = ids.buffers()
        return _between_bytes(body, np.frombuffer(ends, np.int64)[np.searchsorted(starts, bounds)])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _segments(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, part, seg = _encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.dtype).tobytes()
        width = coder.dtype.itemsize
        doc_ids, blobs, size = [], [], 0

        def flush():
            nonlocal doc_ids, blobs, size, seg
            bounds = np.cumsum([len(b) // width for b in blobs])
            low_bits, low, high = EliasFano.encode(bounds)
            row = {
                "part": [part], "seg": [seg], "n_ids": [size // width], "doc_ids": [doc_ids], "width": [width],
                "ids": [b"".join(blobs)], "low_bits": [low_bits], "low": [low], "high": [high],
            }
            doc_ids, blobs, size, seg = [], [], 0, seg + 1
            return pa.RecordBatch.from_pydict(row, schema=_FILE_ARROW)

        for batch in batches:
            for a, b in slices(utf8(batch.column(1))[1], TEXT_BYTES):
                some = batch.slice(a, b - a)
                for doc_id, ids in zip(some.column(0).to_pylist(), coder.encode(some.column(1))):
                    doc_ids.append(doc_id)
                    blobs.append(ids + end)
                    size += len(blobs[-1])
                    if size >= most * width:
                        yield flush()
        if doc_ids:
            yield flush()

    return run


_FILE_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("seg", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("width", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()),
    ]
)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS
) -> None:
    """Write the segments of ``doc_id, text`` to ``folder``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    rows.mapInArrow(_segments(tokenizer, end_id, segment_ids), FILE_SCHEMA).write.parquet(folder)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments with ``start``: ids before each.

    Sums per range meet in one task (one number for each), those of segments within their range only.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seg", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("seg_start"))
    starts = starts.join(parts, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("start"))
    # written, so that the planner knows that this side is small and leaves the ids where they are
    return files.join(written(starts), ["part", "seg"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = len(r["doc_ids"])
            index = EliasFano(n, r["low_bits"], r["low"], r["high"])
            ends = index.select(np.arange(n))
            begins = np.concatenate(([0], ends[:-1]))
            ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(r["start"] + begins, pa.int64()),
                    pa.array(ends - begins, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read from the files."""
    return read_segments(spark, folder).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents' tokens to a new folder and read their digests back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer)
    return token_digests(docs.sparkSession, folder)
