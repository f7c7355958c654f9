"""Fill-in-the-middle documents, cut by code points through a sparse exception index.

Cuts are drawn in code points, the texts are bytes.  The index of some texts holds
only their multibyte characters: where each stands, and how many bytes beyond one
the text has used up to it.  A binary search among these turns code points into
bytes and back; a stretch of ASCII is arithmetic and takes no space.

The draws of a document are the first four 8-digit groups of the SHA-256 of
``<seed>:<doc_id>``, so they depend on nothing else.  A text that holds one of the
marks is left plain; in all others no mark can arise where two parts meet, since a
mark has no end that is also its beginning.

Defined cases: a null text is empty, an empty text is plain; a null ``doc_id`` draws
as the empty id; rows that share an id have the same draws, each for its own length;
of equal rows each gives one; a text is cut as a whole however long it is, alone if
it exceeds a slice; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.words import slices, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents so many are cut, and of these so many begin with the suffix.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SEED = 1


class ExceptionIndex:
    """Code points and bytes of some UTF-8 text; ``points`` and ``bytes`` turn positions of one into the other."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        #: bytes beyond one of the characters before each exception, and of all
        self.excess = np.concatenate(([0], np.cumsum(more)))
        self.at_point = self.at_byte - self.excess[:-1]

    def bytes(self, points: np.ndarray) -> np.ndarray:
        return points + self.excess[np.searchsorted(self.at_point, points)]

    def points(self, at_bytes: np.ndarray) -> np.ndarray:
        """Of positions where a character begins, or of the end."""
        return at_bytes - self.excess[np.searchsorted(self.at_byte, at_bytes)]


def draws(doc_ids: list[int | None], seed: int = SEED) -> np.ndarray:
    """Four 32-bit numbers per document."""
    digests = b"".join(sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:16] for d in doc_ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


_CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


def _cutter(seed: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(1))
            for lo, hi in slices(starts):
                yield _cut_slice(batch.column(0).slice(lo, hi - lo), data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], seed)

    return cut


def _cut_slice(doc_ids: pa.Array, data: np.ndarray, starts: np.ndarray, seed: int) -> pa.RecordBatch:
    index = ExceptionIndex(data)
    begins = index.points(starts)
    n = np.diff(begins)
    h = draws(doc_ids.to_pylist(), seed)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    at = index.bytes(begins[:-1, None] + cuts)
    wanted = (n > 0) & (h[:, 2] % 100 < CUT_PERCENT)
    suffix_first = h[:, 3] % 100 < SUFFIX_FIRST_PERCENT
    raw = data.tobytes()
    forms, outputs = [], []
    for k in range(len(n)):
        text = raw[starts[k] : starts[k + 1]]
        if not wanted[k] or PREFIX in text or SUFFIX in text or MIDDLE in text:
            forms.append("plain")
            outputs.append(text)
            continue
        a, b = at[k] - starts[k]
        parts = [PREFIX, text[:a], SUFFIX, text[b:]]
        if suffix_first[k]:
            parts = parts[2:] + parts[:2]
        forms.append("spm" if suffix_first[k] else "psm")
        outputs.append(b"".join((*parts, MIDDLE, text[a:b])))
    plain = np.array([f == "plain" for f in forms], bool)
    chars = np.stack((cuts[:, 0], cuts[:, 1] - cuts[:, 0], at[:, 0] - starts[:-1], at[:, 1] - at[:, 0]))
    columns = [doc_ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), *(pa.array(c, pa.int64(), mask=plain) for c in chars)]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(outputs, pa.binary()).cast(pa.string(), safe=False)], names=names)


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output`` of each row.

    ``form`` is ``plain``, ``psm`` or ``spm``; the lengths of the parts are null if it is plain.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_cutter(seed), _CUT)


def restored(df: DataFrame) -> DataFrame:
    """Add ``text``, put together from ``output`` and ``form`` alone."""
    marks = "|".join(m.decode() for m in (PREFIX, SUFFIX, MIDDLE))
    part = F.split("output", marks)
    text = (
        F.when(F.col("form") == "psm", F.concat(part[1], part[3], part[2]))
        .when(F.col("form") == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(F.col("output"))
    )
    return df.withColumn("text", text)
