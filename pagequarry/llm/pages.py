"""Main text of web pages, with a suffix array per host for what its pages repeat.

A page is parsed into blocks of text.  Menus, headers, footers, sidebars, adverts,
notices, forms, comments, lists of links outside an article or main element, and
anything invisible are hidden; the markup is only a hint for these.  A form, or a menu
left open, that holds the page's only article hides nothing, nor does one that holds
all text of a page without an article, if a block has ``WRAPPED_WORDS`` words.

All text of the pages, hidden or not, is laid end to end, host by host, and a suffix
array finds the strings of ``LENGTH`` bytes, from the beginning of a word or up to the
end of one, that stand on ``LEAST_PAGES`` distinct pages of the host.  What they cover
is boilerplate, inside an article as well as outside; the unique runs of all blocks
that are not hidden are the page's text.

Only repeated parts have to meet.  Equal strings have equal samples (the least hash of
their ``GRAM``-byte substrings, mixed with the host); samples are counted over all
pages, a filter of fixed size remembers those on enough pages, and only what their
strings cover goes on.  A host of any size is cut into shards of whole pages: each
shard's suffix array counts the distinct pages of each string, and as no page is in
two shards, the sums over the shards are exact.

Defined cases: null html is empty; a null url belongs to a host of its own name;
unclosed elements end with their parents, a cut page ends what is open; pages of a
host with the same text, such as repeated rows, count as one page and each get the
result; an empty table gives an empty result; other columns are left alone.  Strings,
samples and equal pages are told by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.repeats import _window_minima
from pagequarry.llm.suffixes import Prefixes, permuted_common_prefixes, suffix_array
from pagequarry.llm.tables import ids_for_join
from pagequarry.llm.words import U, mixed
from pagequarry.sources.lineage import new_folder, remove_folder, shuffles_freed, written

#: Bytes of a repeated string; the common prefix is told up to the next power of two.
LENGTH = 48
#: On so many pages of a host, however large it is, a string is boilerplate.
LEAST_PAGES = 3
#: Bytes of a substring whose hash can be a sample.
GRAM = 20
SHARD_BYTES = 1 << 21
#: Text of pages that are cut together at the end.
PART_BYTES = 1 << 22
#: Samples that a task gathers before it sends them, in 4,096 buckets.
SAMPLES_HELD = 1 << 22
_BUCKETS = 12
#: Bits of the filters that every executor gets: 8 MB, whatever the corpus.
_FILTER_BITS = 26
#: Between pages and parts of pages; no byte of UTF-8.
_GAP = b"\xff"
LINKED_SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
HIDDEN = frozenset(
    "head script style noscript template nav footer aside form button select option textarea iframe svg object embed"
    " canvas audio video dialog menu datalist map".split()
)
#: Elements that hide their text but may hold a whole page, by design or because they were not closed.
WRAPPERS = frozenset("form nav".split())
#: Words of a block that shows that a wrapper holds a page, where there is no article.
WRAPPED_WORDS = 20
HIDDEN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class names and ids.
HIDDEN_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside ad ads advert adverts advertisement"
    " advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice"
    " notices newsletter subscribe subscription signup popup modal overlay comment comments commentlist disqus respond"
    " replies reply footer header masthead topbar share sharing social related recommended recommendations widget"
    " widgets toolbar pagination pager skip login search copyright disclaimer".split()
)
OWN_WORDS = (frozenset("article post entry story".split()), frozenset("body content text".split()))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


_NO_NAMES: frozenset[str] = frozenset()


@lru_cache(1 << 14)
def _names(text: str) -> frozenset[str]:
    return frozenset(w.lower() for w in _WORD.findall(text))


class Blocks(HTMLParser):
    """Blocks of a page: ``(text, own, hidden)`` in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, reason it is hidden or 0, own
        self.pieces: list[str] = []
        self.linked = self.length = self.links = 0
        self.blocks: list[tuple[str, bool, frozenset[int], bool]] = []
        self.reasons: frozenset[int] = frozenset()
        self.own = 0
        self.soft: set[int] = set()  # reasons that are only names
        self.void: set[int] = set()  # of these, such that hold the page's own part
        self.wraps: set[int] = set()  # reasons that are wrappers
        self.menus: set[int] = set()  # of these, menus: only an article in them is shown
        self.wrapped: frozenset[int] = frozenset()  # reasons around the first own part that only names and wrappers hide
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag among the open elements
        self.solid: list[int] = []  # places of open elements that are not inline
        self.last_reason = 0
        self.found_own = False

    def end_block(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        if text:
            linked = self.linked > LINKED_SHARE * max(1, self.length)
            self.blocks.append((text, self.own > 0, self.reasons, linked))
        self.pieces, self.linked, self.length = [], 0, 0

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        n = len(data) - data.count(" ")
        self.length += n
        if self.links:
            self.linked += n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.pieces.append(" ")
        elif tag not in INLINE:
            self.end_block()
        if tag in VOID:
            return
        values = {k: v or "" for k, v in reversed(attrs)}
        words = _names(f"{values.get('class', '')} {values.get('id', '')}") if attrs else _NO_NAMES
        role = values.get("role", "").lower()
        own = tag in ("article", "main") or role in ("main", "article") or values.get("itemprop") == "articleBody"
        hard = (
            tag in HIDDEN
            or role in HIDDEN_ROLES
            or "hidden" in values
            or values.get("aria-hidden") == "true"
            or "display:none" in values.get("style", "").replace(" ", "").lower()
            or (tag == "header" and not self.own)
        )
        soft = not hard and tag not in ("html", "body", "article", "main") and bool(words & HIDDEN_WORDS)
        if soft and self.own and tag in ("h1", "h2", "header"):
            soft = False
        own = own or (not hard and not soft and all(words & some for some in OWN_WORDS))
        if own and not self.found_own and not (self.reasons - self.soft):
            # a name like "has-sidebar" on what holds the article says nothing
            self.found_own = True
            self.void |= self.reasons
        elif own and not self.wrapped and not (self.reasons - self.soft - self.wraps):
            self.wrapped = self.reasons
        reason = 0
        if hard or soft:
            self.last_reason += 1
            reason = self.last_reason
            self.reasons |= {reason}
            if soft:
                self.soft.add(reason)
            elif tag in WRAPPERS:
                self.wraps.add(reason)
                if tag == "nav":
                    self.menus.add(reason)
        self.own += own
        self.links += tag == "a"
        self.places[tag].append(len(self.open))
        if tag not in INLINE:
            self.solid.append(len(self.open))
        self.open.append((tag, reason, own))

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.places[tag]:
            if tag == "br":
                self.pieces.append(" ")
            return
        if tag in INLINE and self.solid and self.solid[-1] > self.places[tag][-1]:
            return  # an inline element does not end the blocks inside it
        if tag not in INLINE:
            self.end_block()
        while True:
            closed, reason, own = self.open.pop()
            self.places[closed].pop()
            if closed not in INLINE:
                self.solid.pop()
            if reason:
                self.reasons -= {reason}
            self.own -= own
            self.links -= closed == "a"
            if closed == tag:
                return

    def lift(self) -> None:
        """Let wrappers hide nothing if the page's article, or without one all of its text, is inside."""
        if self.found_own:
            return
        if self.wrapped:
            self.void |= self.wrapped - self.menus
        elif self.blocks and all(b[2] - self.void for b in self.blocks):
            inside = [b for b in self.blocks if not (b[2] - self.wraps) and not b[3]]
            text, _, reasons, _ = max(inside, key=lambda b: len(b[0]), default=("", False, frozenset(), False))
            if len(text.split()) >= WRAPPED_WORDS:
                self.void |= reasons

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)


def parse(html: str | None) -> list[tuple[str, bool, bool]]:
    """``(text, own, undecided)`` of each block of a page."""
    p = Blocks()
    p.feed(html or "")
    p.close()
    p.end_block()
    p.lift()
    out = []
    for text, own, reasons, linked in p.blocks:
        hidden = bool(reasons - p.void - (p.wrapped if own and not p.found_own else frozenset()))
        out.append((text, own and not hidden, not own and not hidden and not linked))
    return out


_PARSED = "part long, row long, page_id long, url string, host string, stream string, first boolean, wanted array<int>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks, one in each line, whether no earlier page of the task has the same, and which lines are not hidden.

    Parts are pages of a task one after the other, of ``PART_BYTES`` characters or one lot of 256 pages.
    """
    row, seen = TaskContext.get().partitionId() << 40, set()
    part, size = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            streams, first, wanted = [], [], []
            for host, html in zip(some.column(2).to_pylist(), some.column(3).to_pylist()):
                blocks = parse(html)
                streams.append("\n".join(b[0] for b in blocks))
                wanted.append([i for i, b in enumerate(blocks) if b[1] or b[2]])
                page = hash((host, streams[-1]))
                first.append(page not in seen)
                seen.add(page)
            n = some.num_rows
            columns = [*some.columns[:3], pa.array(streams, pa.string()), pa.array(first, pa.bool_()), pa.array(wanted, pa.list_(pa.int32()))]
            columns = [pa.array(np.full(n, part)), pa.array(np.arange(row, row + n)), *columns]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PARSED.split(", ")])
            row += n
            size += sum(map(len, streams))
            if size >= PART_BYTES:
                part, size = part + 1, 0


# ---------------------------------------------------------------- strings


def _laid_out(pages: list[bytes]) -> np.ndarray:
    """Bytes moved up by one, 0 after each page or part."""
    text = np.frombuffer(_GAP.join(pages) + _GAP, np.uint8).astype(np.uint16) + 1
    text[text == 256] = 0
    return text


def _windows(text: np.ndarray) -> np.ndarray:
    """Places of the strings of ``LENGTH`` bytes that begin or end with a word, within a page or part."""
    gap = text == 0
    space = (text == 33) | (text == 11) | gap
    at = ~space
    at[1:] &= space[:-1]
    last = ~space[:-1] & space[1:]
    if len(text) > LENGTH:
        at[:-LENGTH] |= last[LENGTH - 1 :]
    at = np.flatnonzero(at[: max(0, len(text) - LENGTH + 1)])
    gaps = np.concatenate((np.zeros(1, np.int32), np.cumsum(gap, dtype=np.int32)))
    return at[gaps[at] == gaps[at + LENGTH]]


@lru_cache(1 << 16)
def _host_hash(host: str) -> int:
    return int.from_bytes(hashlib.blake2b(host.encode(), digest_size=8).digest(), "little")


def _host_hashes(hosts: list[str]) -> np.ndarray:
    return np.array([_host_hash(h) for h in hosts], U)


def _sampled(hosts: list[str], pages: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where pages begin; place, page and sample of each string."""
    size = np.array([len(p) + 1 for p in pages], np.int64)
    begins = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    text = _laid_out(pages)
    at = _windows(text)
    owner = np.searchsorted(begins, at, "right") - 1
    if not len(at):
        return begins, at, owner, np.zeros(0, U)
    prefixes = Prefixes(text)
    grams = mixed((prefixes.sums[GRAM:] - prefixes.sums[:-GRAM]) * prefixes.inverse[: len(text) - GRAM + 1])
    least = _window_minima(grams, LENGTH - GRAM + 1)[at]
    return begins, at, owner, mixed(least ^ _host_hashes(hosts)[owner])


def _slot(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of hashes in the filter of samples: the bucket first."""
    bucket = (hashes & U((1 << _BUCKETS) - 1)).astype(np.int64)
    inside = ((hashes >> U(_BUCKETS)) & U((1 << (_FILTER_BITS - _BUCKETS)) - 1)).astype(np.int64)
    return (bucket << (_FILTER_BITS - _BUCKETS - 3)) + (inside >> 3), inside & 7


def _each_page(batches: Iterator[pa.RecordBatch], bytes_held: int = 1 << 18) -> Iterator[tuple]:
    """Some rows at a time as lists of columns; the last column, a text, as bytes."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        columns[-1] = [t.encode() for t in columns[-1]]
        ends = np.cumsum([len(t) for t in columns[-1]])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + bytes_held)))
            yield tuple(c[lo:hi] for c in columns)
            lo = hi


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, samples``: samples of the pages, each up to ``LEAST_PAGES`` times, without the bits of the bucket."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        values = np.repeat(values, np.minimum(counts, LEAST_PAGES))
        bucket = (values & U((1 << _BUCKETS) - 1)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        some, first = np.unique(bucket[order], return_index=True)
        blobs = [v.tobytes() for v in np.split((values[order] >> U(_BUCKETS)).astype("<u4"), first[1:])] if len(some) else []
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(blobs, pa.binary())], names=["bucket", "samples"])

    for hosts, pages in _each_page(batches):
        _, _, owner, sample = _sampled(hosts, pages)
        # once in each page; most neighbours share one
        new = np.flatnonzero((np.diff(sample, prepend=U(0)) != 0) | (np.diff(owner, prepend=-1) != 0))
        owner, sample = owner[new], sample[new]
        order = np.lexsort((sample, owner))
        owner, sample = owner[order], sample[order]
        held.append(sample[(np.diff(sample, prepend=U(0)) != 0) | (np.diff(owner, prepend=-1) != 0)])
        n += len(held[-1])
        if n >= SAMPLES_HELD:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _filter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; the bits of the samples that are on enough pages."""
    last, held = None, []

    def out() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        bits = np.zeros(1 << (_FILTER_BITS - _BUCKETS), np.uint8)
        bits[values[counts >= LEAST_PAGES] & np.uint32(len(bits) - 1)] = 1
        blob = np.packbits(bits, bitorder="little").tobytes() if bits.any() else b""
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "bits"])

    for batch in batches:
        for bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last and held:
                yield out()
                held = []
            last = bucket
            held.append(np.frombuffer(blob, "<u4"))
    if held:
        yield out()


def _sample_filter(pages: DataFrame) -> np.ndarray:
    """A bit for each sample on ``LEAST_PAGES`` pages: without one, a string is on fewer."""
    found = pages.mapInArrow(_samples, "bucket int, samples binary")
    parts = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_filter_parts, "bucket int, bits binary")
    out, width = np.zeros(1 << (_FILTER_BITS - 3), np.uint8), 1 << (_FILTER_BITS - _BUCKETS - 3)
    for r in parts.where("bits <> X''").collect():
        out[r.bucket * width : (r.bucket + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


_PARTS = "host string, page long, parts binary"


def _repeated_parts(sent):
    """The bytes of each page under strings whose sample passes the filter, and a hash of the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for hosts, pages in _each_page(batches):
            begins, at, owner, sample = _sampled(hosts, pages)
            byte, bit = _slot(sample)
            keep = ((bits[byte] >> bit.astype(np.uint8)) & 1).astype(bool)
            at, owner = at[keep], owner[keep]
            if not len(at):
                continue
            # strings that touch are one part; none of two pages do, as there is a gap
            new = np.flatnonzero(np.diff(at, prepend=-LENGTH - 1) > LENGTH)
            first, end, whose = at[new], at[np.append(new[1:], len(at)) - 1] + LENGTH, owner[new]
            first, end = (first - begins[whose]).tolist(), (end - begins[whose]).tolist()
            parts: dict[int, list[bytes]] = {}
            for p, a, b in zip(whose.tolist(), first, end):
                parts.setdefault(p, []).append(pages[p][a:b])
            ids = [int.from_bytes(hashlib.blake2b(pages[p], digest_size=8).digest(), "little", signed=True) for p in parts]
            blobs = [_GAP.join(x) for x in parts.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hosts[p] for p in parts], pa.string()), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())],
                names=["host", "page", "parts"],
            )

    return run


def strings_on_pages(pages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of a shard, as hashes, and the distinct pages each is on."""
    size = np.array([len(p) + 1 for p in pages])
    owner = np.repeat(np.arange(len(pages)), size)
    text = _laid_out(pages)
    wanted = np.zeros(len(text), bool)
    wanted[_windows(text)] = True
    order = suffix_array(text)
    places = order[wanted[order]]
    if not len(places):
        return np.zeros(0, U), np.zeros(0, np.int64)
    prefixes = Prefixes(text)
    group = np.cumsum(permuted_common_prefixes(places, prefixes, 63) < LENGTH) - 1
    once = np.unique(group * len(pages) + owner[places]) // len(pages)
    first = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
    return prefixes(places[first], LENGTH), np.bincount(once)


def _of_host(strings: np.ndarray, host_hashes) -> np.ndarray:
    return mixed(strings ^ host_hashes)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host, shard and page; copies of a page are neighbours."""
    key, held, last = None, [], None

    def out():
        strings, pages = strings_on_pages(held)
        strings = _of_host(strings, _host_hashes([key[0]]))
        return pa.RecordBatch.from_arrays([pa.array(strings.view(np.int64)), pa.array(pages)], names=["string", "pages"])

    for batch in batches:
        for host, shard, page, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (host, shard) != key:
                if held:
                    yield out()
                key, held, last = (host, shard), [], None
            if page != last:
                held.append(parts)
            last = page
    if held:
        yield out()


def _string_filter(strings: DataFrame) -> np.ndarray:
    """A bit for the low bits of each string."""
    slot = F.col("string").bitwiseAND(F.lit((1 << _FILTER_BITS) - 1))
    part = F.shiftright(slot, 15).alias("part")
    out = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    for r in strings.groupBy(part).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect():
        out[r.part << 12 : (r.part + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def _occurrences(sent):
    """The strings of the pages that pass the filter and touch a line that is not hidden."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for parts, rows, hosts, wanted, pages in _each_page(batches):
            begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pages])))
            text = _laid_out(pages)
            at = _windows(text)
            owner = np.searchsorted(begins, at, "right") - 1
            string = _of_host(Prefixes(text)(at, LENGTH), _host_hashes(hosts)[owner])
            slot = (string & U((1 << _FILTER_BITS) - 1)).astype(np.int64)
            keep = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            if not len(keep):
                continue
            # lines are told by their number in all pages together
            ends = np.flatnonzero((text == 11) | (text == 0))
            line_0 = np.searchsorted(ends, begins[:-1])
            shown = np.zeros(len(ends) + 1, np.int64)
            shown[1:][np.array([line_0[i] + k for i, w in enumerate(wanted) for k in w], np.int64)] = 1
            shown = np.cumsum(shown)
            first, last = np.searchsorted(ends, at[keep]), np.searchsorted(ends, at[keep] + LENGTH - 1)
            keep = keep[shown[last + 1] > shown[first]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(parts)[owner[keep]], pa.int64()),
                    pa.array(np.array(rows)[owner[keep]], pa.int64()),
                    pa.array((at[keep] - begins[owner[keep]]).astype(np.int32)),
                    pa.array(string[keep].view(np.int64)),
                ],
                names=["part", "row", "at", "string"],
            )

    return run


def unique_runs(stream: str, wanted: list[int], covered: np.ndarray | list[int] | None) -> str:
    """The wanted lines of a stream without what the strings beginning at ``covered`` cover.

    Words of a stream stand between single spaces or line ends.
    """
    if covered is None or not len(covered):
        lines = stream.split("\n")
        return " ".join([lines[i] for i in wanted])
    text = np.frombuffer(stream.encode(), np.uint8)
    at = np.asarray(covered, np.int64)
    edges = np.bincount(at, minlength=len(text) + 1)
    edges -= np.bincount(np.minimum(at + LENGTH, len(text)), minlength=len(text) + 1)
    gone = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.cumsum(edges[:-1]) > 0)))
    line = text == 10
    ends = np.append(np.flatnonzero(line | (text == 32)), len(text))
    begins = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    shown = np.zeros(np.count_nonzero(line) + 1, bool)
    shown[wanted] = True
    lines = np.concatenate((np.zeros(1, np.int64), np.cumsum(line[ends[:-1]])))
    # a word goes if all of it is covered
    keep = shown[lines] & (gone[ends] - gone[begins] < ends - begins)
    # a word takes the space or line end behind it along
    left = np.append(text, np.uint8(32))[np.repeat(keep, ends + 1 - begins)]
    left[left == 10] = 32
    return left[:-1].tobytes().decode()


def _texts(pages: pa.Table, found: pa.Table) -> pa.Table:
    """The texts of the pages of a part, and where repeated strings begin on them."""
    covered: dict[int, np.ndarray] = {}
    if found.num_rows:
        row, at = found.column("row").to_numpy(), found.column("at").to_numpy()
        order = np.argsort(row, kind="stable")
        some, first = np.unique(row[order], return_index=True)
        covered = dict(zip(some.tolist(), np.split(at[order], first[1:])))
    columns = (pages.column(c).to_pylist() for c in ("row", "stream", "wanted"))
    texts = [unique_runs(stream, wanted, covered.get(row)) for row, stream, wanted in zip(*columns)]
    return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(texts, pa.string())})


def _kept(parsed: DataFrame) -> DataFrame:
    """Parsed pages in buckets of ``part``: each task writes its own, so that what is found comes to them.

    The table is named only until it is read; its files stay.
    """
    spark = parsed.sparkSession
    path, name = new_folder(spark, "stage"), f"parsed_pages_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parsed.write.bucketBy(buckets, "part").option("compression", "zstd").option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page."""
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    spark = pages.sparkSession
    with shuffles_freed(spark):
        parsed = _kept(rows.mapInArrow(_parsed, _PARSED))
        found = _found(parsed)
    texts = parsed.select("part", "row", "page_id", "url", "stream", "wanted").groupBy("part").cogroup(found.groupBy("part"))
    texts = texts.applyInArrow(_texts, "page_id long, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _found(parsed: DataFrame) -> DataFrame:
    """``part, row, at``: where the strings begin that enough pages of a host have, if a line that is not hidden has them."""
    spark = parsed.sparkSession
    context = spark.sparkContext
    distinct = parsed.where("first and stream <> ''").select("host", "stream")
    sent = context.broadcast(_sample_filter(distinct))
    folder = new_folder(spark, "stage")
    parts = written(distinct.mapInArrow(_repeated_parts(sent), _PARTS), folder)
    hosts = written(parts.groupBy("host").agg(F.sum(F.octet_length("parts")).alias("bytes")))
    shard = F.pmod(F.xxhash64("page"), F.ceil((F.col("bytes") + 1) / SHARD_BYTES)).cast("long")
    parts = parts.join(hosts, "host").select("host", shard.alias("shard"), "page", "parts")
    parts = parts.repartition("host", "shard").sortWithinPartitions("host", "shard", "page")
    strings = parts.mapInArrow(_shards, "string long, pages long")
    strings = strings.groupBy("string").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    strings = written(strings.select("string"))
    remove_folder(spark, folder)

    open_ = parsed.where("size(wanted) > 0").select("part", "row", "host", "wanted", "stream")
    sent = context.broadcast(_string_filter(strings))
    found = open_.mapInArrow(_occurrences(sent), "part long, row long, at int, string long")
    return written(found.join(ids_for_join(strings), "string").select("part", "row", "at"))
