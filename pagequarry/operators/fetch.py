"""Fetching pages: URLs meet the copy of their page that counts, and only that copy's HTML moves.

A page is found in three steps.  A Bloom filter of the wanted URLs is applied where
pages are scanned.  What passes meets the exact URLs without its HTML: a place in
the files, a file and a row, stands for it, and the copy that counts is chosen
among the places.  Then the HTML of the chosen places is read.  HTML is never
sorted and never in a window; pages nobody asks for are not shuffled, but for the
errors of the filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.lineage import written

#: Unwanted URLs that may pass the filter, and its greatest size: 8 MB, which hold 7 million URLs at that rate.
ERROR_RATE, MOST_BITS = 0.01, 1 << 26
#: A broadcast of this many URLs stays within some megabytes.
BROADCAST_LINKS = 10_000
#: A filter is an array of arrays of this many words of 64 bits.
_CHUNK = 512


def filter_size(n: int, error: float = ERROR_RATE, most: int = MOST_BITS) -> tuple[int, int]:
    """Bits and hashes of a filter of ``n`` values; if ``most`` are too few for the rate, what they can do."""
    wanted = -max(n, 1) * math.log(error) / math.log(2) ** 2
    bits = min(max(64 * _CHUNK, 1 << math.ceil(math.log2(max(wanted, 1)))), most)
    # more hashes than the rate asks for would only cost time
    return bits, max(1, min(round(bits / max(n, 1) * math.log(2)), math.ceil(-math.log2(error))))


def _bits_of(value: Column, bits: int, hashes: int) -> list[Column]:
    one, two = F.xxhash64(value), F.xxhash64(value, F.lit(1))
    # the second hash, made odd, is the step; both are cut so that no sum overflows
    start, step = F.pmod(one, F.lit(bits)), F.pmod(two, F.lit(bits)).bitwiseOR(F.lit(1))
    return [F.pmod(start + i * step, F.lit(bits)) for i in range(hashes)]


def bloom_filter(values: DataFrame, name: str, n: int, error: float = ERROR_RATE, most: int = MOST_BITS) -> DataFrame:
    """One row ``bits``: the filter of a column of ``values``, at most ``n`` of them.

    Words are or-ed where they arise, then per word; the last step gathers chunks, whose number is bounded by ``most``.
    """
    bits, hashes = filter_size(n, error, most)
    at = F.explode(F.array(*_bits_of(F.col(name), bits, hashes))).alias("at")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    own = values.select(at).select(F.expr("shiftright(at, 6)").alias("word"), bit.alias("bits"))
    every = values.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = own.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = lambda key: F.transform(F.sort_array(F.collect_list(F.struct(key, "bits"))), lambda x: x["bits"]).alias("bits")
    chunks = words.groupBy(F.expr(f"word div {_CHUNK}").alias("chunk")).agg(in_order("word"))
    return chunks.agg(in_order("chunk"))


def may_hold(bloom: DataFrame, value: Column, n: int, error: float = ERROR_RATE, most: int = MOST_BITS) -> Column:
    """False only if ``value`` is not in the filter."""
    bits, hashes = filter_size(n, error, most)
    words = bloom.scalar()
    found = None
    for at in _bits_of(value, bits, hashes):
        word = F.get(F.get(words, (at / (64 * _CHUNK)).cast("int")), F.pmod((at / 64).cast("int"), F.lit(_CHUNK)))
        hit = F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1
        found = hit if found is None else found & hit
    return found


def has_places(pages: DataFrame) -> bool:
    """Whether the rows of ``pages`` can be named by a file and a row of it."""
    try:
        return bool(pages.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def located(pages: DataFrame) -> DataFrame:
    """``_url, html, _copy, _file, _row`` of stored pages; pages that do not come from files are written first."""
    copy = F.col("page_id").cast("bigint") if "page_id" in pages.columns else F.lit(None).cast("bigint")
    own = pages.select(F.col("url").alias("_url"), "html", copy.alias("_copy"))
    if not has_places(own):
        own = written(own)
    return own.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _same(file: str, row: str) -> Column:
    """Equality of two places that is no key of a join: pages are dealt by URL, as bucketed ones are already."""
    return F.col("_file").bitwiseXOR(F.col(file)).bitwiseOR(F.col("_row").bitwiseXOR(F.col(row))) == 0


def _joined(pages: DataFrame, few: DataFrame, url: str, n: int) -> DataFrame:
    """An inner join that hashes the smaller side: sent to all executors if it is small, else dealt by URL."""
    few = F.broadcast(few) if n <= BROADCAST_LINKS else few.hint("shuffle_hash")
    return pages.join(few, pages["_url"] == few[url])


def latest_copy(wanted: DataFrame, url: str, pages: DataFrame, error: float = ERROR_RATE) -> DataFrame:
    """Join unique URLs with their pages; of a page stored several times the copy with the greatest ``page_id`` counts.

    A null ``page_id`` is less than any other.  Of copies that share it, as of all
    copies where there is no such column, the one with the least hash of its HTML
    counts.  ``wanted`` must be cheap to read: it is read several times.
    """
    n = wanted.count()
    own = located(pages)
    if n > BROADCAST_LINKS:
        # below, the exact URLs are sent to the scan themselves
        bloom = written(bloom_filter(wanted, url, n, error))
        own = own.where(may_hold(bloom, F.col("_url"), n, error))
    urls = wanted.select(F.col(url).alias("_wanted"))
    places = written(_joined(own.drop("html"), urls, "_wanted", n).select("_url", "_copy", "_file", "_row"))
    best = places.groupBy("_url").agg(F.max("_copy").alias("_best"), F.count("*").alias("_n"))
    if best.where("_n > 1").isEmpty():
        chosen = places
    else:
        best = best.where("_n > 1")
        single = places.join(best, "_url", "left_anti")
        top = places.join(best, "_url").where(F.col("_copy").eqNullSafe(F.col("_best")))
        chosen = single.unionByName(_untied(written(top.drop("_best", "_n")), own))
    chosen = chosen.select(F.col("_url").alias("_wanted"), F.col("_file").alias("_its_file"), F.col("_row").alias("_its_row"))
    chosen = written(chosen.join(wanted, chosen["_wanted"] == wanted[url]).drop("_wanted"))
    found = _joined(own.drop("_copy"), chosen, url, chosen.count()).where(_same("_its_file", "_its_row"))
    return found.drop("_url", "_file", "_row", "_its_file", "_its_row")


def _untied(top: DataFrame, own: DataFrame) -> DataFrame:
    """One place per URL: of several, the one with the least hash of its HTML; equal copies are one as good as the other."""
    rows = top.groupBy("_url").agg(F.count("*").alias("_n"))
    several = top.join(rows.where("_n > 1"), "_url", "left_semi")
    alone = top.join(rows.where("_n = 1"), "_url", "left_semi")
    several = written(several.select(F.col("_url").alias("_tied"), F.col("_file").alias("_its_file"), F.col("_row").alias("_its_row")))
    n = several.count()
    if n:
        hashed = own.withColumn("_hash", F.xxhash64("html")).drop("html")
        hashed = _joined(hashed, several, "_tied", n).where(_same("_its_file", "_its_row"))
        hashed = written(hashed.select("_url", "_copy", "_file", "_row", "_hash"))
        least = hashed.groupBy("_url").agg(F.min("_hash").alias("_hash"))
        hashed = hashed.join(least, ["_url", "_hash"])
        # of equal copies one place: its row, then its file
        row = hashed.groupBy("_url").agg(F.min("_row").alias("_row"))
        hashed = hashed.join(row, ["_url", "_row"])
        alone = alone.unionByName(hashed.groupBy("_url", "_copy", "_row").agg(F.min("_file").alias("_file")))
    return alone
