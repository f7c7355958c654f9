"""Suffix arrays by induced sorting, with permuted common prefixes, in whole-array steps.

Suffixes are classified as smaller or larger than their right neighbour.  The
leftmost-smaller (LMS) substrings are sorted by induction and named; if names
repeat, the string of names is sorted, which is a third as long; from the order of
the LMS suffixes the order of all is induced, first the larger ones from left to
right, then the smaller ones from right to left, a bucket at a time.  The string
of names has as many symbols as places, so that its buckets are single elements;
it is sorted by doubling ranks instead, which array steps can do.

``DEPTH`` limits what is told apart: suffixes that agree in their first ``DEPTH``
bytes or more may stand in either order.
"""

from __future__ import annotations

import numpy as np

DEPTH = 256
_P = np.uint64(0x9E3779B97F4A7C15 | 5)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the factor and of its inverse; they are kept, up to those of the longest text so far."""
    if len(_POWERS[0]) < n:
        for k, factor in enumerate((_P, _P_INVERSE)):
            steps = np.full(1 << (n - 1).bit_length(), factor, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


class Prefixes:
    """Polynomial hashes of any substring of ``s``."""

    def __init__(self, s: np.ndarray):
        power, self.inverse = _powers(len(s) + 1)
        value = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)
        value ^= value >> np.uint64(31)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * power[: len(s)], dtype=np.uint64)))

    def __call__(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverse[at]


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last symbol is the least and alone."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int32) - s[:-1])
    # in a run of equal symbols, what comes after the run decides
    decides = np.where(step != 0, np.arange(n - 1), n - 1)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.append(step, 1)[decides] > 0
    return out


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes (or, to sort LMS substrings, the LMS places) in order."""
    n, k = len(s), len(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    order = np.full(n, -1, np.int64)
    symbols = s[lms]
    own = np.bincount(symbols, minlength=k)
    grouped = np.argsort(symbols, kind="stable")
    at = symbols[grouped]
    order[(ends - own)[at] + np.arange(len(lms)) - (np.cumsum(own) - own)[at]] = lms[grouped]

    larger = ~smaller
    head = begins.copy()

    def put_larger(block: np.ndarray) -> None:
        p = block - 1
        p = p[(p >= 0) & larger[p]]
        if len(p):
            c = s[p]
            some = np.argsort(c, kind="stable")
            c, count = c[some], np.bincount(c, minlength=k)
            order[head[c] + np.arange(len(p)) - (np.cumsum(count) - count)[c]] = p[some]
            np.add(head, count, out=head)

    present = np.flatnonzero(sizes)
    for c in present:
        lo = begins[c]
        while lo < head[c]:
            hi = head[c]
            put_larger(order[lo:hi])
            lo = hi
        put_larger(order[ends[c] - own[c] : ends[c]])

    tail = ends.copy()

    def put_smaller(block: np.ndarray) -> None:
        p = block - 1
        p = p[(p >= 0) & smaller[p]]
        if len(p):
            c = s[p]
            some = np.argsort(c, kind="stable")
            c, count = c[some], np.bincount(c, minlength=k)
            order[tail[c] - 1 - (np.arange(len(p)) - (np.cumsum(count) - count)[c])] = p[some]
            np.subtract(tail, count, out=tail)

    for c in present[::-1]:
        hi = ends[c]
        while tail[c] < hi:
            lo = tail[c]
            put_smaller(order[lo:hi][::-1])
            hi = lo
        put_smaller(order[begins[c] : head[c]][::-1])
    order[0] = n - 1
    return order


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string of names in order, told apart by ``depth`` names at least."""
    rank, width = names.astype(np.int64), 1
    n = len(rank)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or width >= depth or width >= n:
            return order


def suffix_array(text: np.ndarray, prefixes: Prefixes | None = None) -> np.ndarray:
    """Places of ``text`` (small non-negative integers) in the order of their suffixes."""
    s = np.append(text.astype(np.uint16) + 1, np.uint16(0))
    n = len(s)
    if n < 3:
        return np.argsort(text, kind="stable")
    smaller = _smaller(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    sizes = np.bincount(s)
    if len(lms) > 1:
        sorted_ = _induce(s, smaller, lms, sizes)
        sorted_ = sorted_[is_lms[sorted_]]
        # an LMS substring ends with the next LMS place
        length = np.zeros(n, np.int64)
        length[lms] = np.append(np.diff(lms) + 1, 1)
        value = Prefixes(s)(sorted_, length[sorted_])
        differ = (np.diff(value) != 0) | (np.diff(length[sorted_]) != 0)
        names = np.zeros(n, np.int64)
        names[sorted_] = np.concatenate(([0], np.cumsum(differ)))
        names = names[lms]
        order = np.argsort(names) if differ.all() else _by_doubling(names, DEPTH // 2)
        lms = lms[order]
    return _induce(s, smaller, lms, sizes)[1:]


def permuted_common_prefixes(places: np.ndarray, prefixes: Prefixes, most: int = 127) -> np.ndarray:
    """For places in suffix order: bytes each has in common with the one before, up to ``most`` (a power of two less one).

    Indexed like ``places``; 0 for the first.
    """
    n = len(prefixes.sums) - 1
    common = np.zeros(len(places), np.int64)
    a, b = places[1:], places[:-1]
    step = (most + 1) // 2
    while step:
        x, y = a + common[1:], b + common[1:]
        fits = np.maximum(x, y) + step <= n
        x, y = np.where(fits, x, 0), np.where(fits, y, 0)
        length = np.where(fits, step, 0)
        common[1:] += np.where(fits & (prefixes(x, length) == prefixes(y, length)), step, 0)
        step //= 2
    return common
