"""Words, word hashes and word shingles of many texts at once.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return.  Texts come as Arrow columns; the bytes are read in
place, and all arrays cover one slice of at most ``SLICE_BYTES`` bytes (or one
text), so memory does not follow the size of a batch.  A null text has no words.

Hashes have 64 bits: equal words always agree, and two different words agree
with a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same characters for Spark's ``btrim`` and for Java patterns.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
NO_SPACES = r"[^\x20\x09-\x0D]+"
WIDTH = 5
SLICE_BYTES = 1 << 20

U = np.uint64
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
_BASE = U(0x9E3779B97F4A7C15 | 5)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit integers."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@lru_cache(2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
    if lower:
        values[65:91] = values[97:123]
    values[list(SPACE)] = 0
    return values


_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins; the last entry is the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1] if starts else np.zeros(1, np.int64)
    if data is None or len(starts) < 2:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or one row."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


class Words:
    """Words of some texts: ``hashes``, first and end byte of each, and ``first``: index of each text's first word."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lower: bool = True):
        n = len(data)
        self.rows = len(starts) - 1
        if not n:
            self.hashes, self.begin, self.end = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.first = np.zeros(self.rows + 1, np.int64)
            return
        word = _IS_WORD[data]
        cut = np.zeros(n + 1, bool)
        cut[starts] = True
        gap = ~word
        self.begin = np.flatnonzero(word & (np.concatenate(([True], gap[:-1])) | cut[:-1]))
        self.end = np.flatnonzero(word & (np.concatenate((gap[1:], [True])) | cut[1:])) + 1
        self.first = np.searchsorted(self.begin, starts)
        if not len(self.begin):
            self.hashes = np.zeros(0, U)
            return
        power, inverse = _powers(n + 1)
        sums = np.add.reduceat(_byte_values(lower)[data] * power[:n], self.begin)
        self.hashes = mixed(sums * inverse[self.begin])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes in order, and where each text's begin.

        A text of fewer words has one, of all its words; one without words has none.
        """
        h, first = self.hashes, self.first
        words = np.diff(first)
        count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
        begins = np.concatenate(([0], np.cumsum(count)))
        factors = mixed(np.arange(1, width + 1, dtype=U)) | U(1)
        total = int(begins[-1])
        # index of the first word of each shingle
        at = np.arange(total) - np.repeat(begins[:-1], count) + np.repeat(first[:-1], count)
        length = np.repeat(np.minimum(words, width), count)
        out = length.astype(U)
        padded = np.concatenate((h, np.zeros(width, U)))
        for k in range(width):
            term = padded[at + k] * factors[k]
            out += np.where(length > k, term, U(0)) if (words < width).any() else term
        return mixed(out), begins


def each_slice(column, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """Words of each slice of a column, with its range of rows."""
    data, starts = utf8(column)
    for lo, hi in slices(starts):
        yield lo, hi, Words(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], lower)


def exact_shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Shingle hashes of one text, distinct and sorted."""
    data, starts = utf8(pa.array([text], pa.string()))
    return np.unique(Words(data, starts).shingles(width)[0])
