"""From listing pages to the links that should be fetched."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import let, per_application, with_once
from ..functions.urls import absolute_url, is_malformed, is_valid_url
from ..plans.spec import PageGroup, Selector, Spec
from ..sources.lineage import written
from .extract import components, shred_for, value_shape
from .fetch import latest_copy
from .seen import unseen


WANTED_BY = "array<struct<group_id:int,seed_pos:bigint>>"


def seeds(spark: SparkSession, spec: Spec, strict: bool = True) -> DataFrame:
    """``(base_url, wanted_by)``: the valid seed URLs of a spec and the groups that list them.

    A group that repeats a URL keeps the first position.
    """
    wanted: dict[str, dict[int, int]] = {}
    for g, group in enumerate(spec.groups):
        for p, u in enumerate(group.urls):
            wanted.setdefault(u, {}).setdefault(g, p)
    rows = [(u, list(by.items())) for u, by in wanted.items()]
    df = spark.createDataFrame(rows, f"base_url string, wanted_by {WANTED_BY}")
    return df.filter(_valid("base_url", strict))


def group_seeds(start: DataFrame) -> DataFrame:
    """The same from a table ``(group_id, seed_pos, base_url)``.

    The array per URL has at most one entry per group of the spec.
    """
    first = start.groupBy("base_url", "group_id").agg(F.min("seed_pos").alias("seed_pos"))
    by = F.collect_list(F.struct("group_id", "seed_pos")).alias("wanted_by")
    return first.groupBy("base_url").agg(by)


def _as_list(selector: Selector, value: Column) -> Column:
    """The links of one page as an array, cut at the first value that is not a string."""
    path = []
    node = selector
    while node.child is not None:
        path.append("c0")
        node = node.child
    for name in path:
        value = value[name]
    shape = value_shape(node)
    if node.select == "first":
        if shape == "mixed":
            return value["vals"]
        return value if shape == "list" else F.when(value.isNotNull(), F.array(value))
    if shape == "string":
        return value

    def strings(vals: Column) -> Column:
        if shape == "list":
            return F.array().cast("array<string>")
        bad = F.filter(
            F.transform(vals, lambda v, i: F.when(v["is_list"], i)), lambda i: i.isNotNull()
        )
        upto = F.coalesce(F.get(bad, F.lit(0)), F.size(vals))
        return F.transform(F.slice(vals, F.lit(1), upto), lambda v: F.get(v["vals"], F.lit(0)))

    return let(value, strings)


def per_tree(groups: tuple[PageGroup, ...], tree: str, value_of) -> tuple[Column, Column]:
    """One value per distinct selector tree, and the choice among them for a group.

    The first column is a struct with a field per tree, null unless a group in
    ``wanted_by`` uses it; the second picks the field for ``group_id``.
    """
    shared: dict[Selector, list[int]] = {}
    for i, g in enumerate(groups):
        shared.setdefault(getattr(g, tree), []).append(i)
    fields, choice = [], F
    for i, (selector, ids) in enumerate(shared.items()):
        asked = F.exists("wanted_by", _is_one_of(ids))
        fields.append(F.when(asked, value_of(selector)).alias(f"t{i}"))
        choice = choice.when(F.col("group_id").isin(ids), F.col(f"trees.t{i}"))
    return F.struct(*fields), choice


def _is_one_of(ids: list[int]):
    return lambda w: w["group_id"].isin(ids)


@per_application
def _links_of(dom: str, selector: Selector) -> Column:
    def readable(links: Column) -> Column:
        bad = F.filter(
            F.transform(links, lambda x, i: F.when(is_malformed(x), i)), lambda i: i.isNotNull()
        )
        return F.slice(links, F.lit(1), F.coalesce(F.get(bad, F.lit(0)), F.size(links)))

    return let(
        let(components(dom, selector), lambda v: _as_list(selector, v)), readable
    )


def page_links(listing: DataFrame, spec: Spec) -> DataFrame:
    """All links of listing pages ``(base_url, html, wanted_by)``, one row each and group.

    A page is parsed once, however many groups list it.  A link that cannot
    even be split ends its page, as do values that are not strings; what came
    before is kept.
    """
    parsed = shred_for(listing, *(g.url_selectors for g in spec.groups))
    trees, links = per_tree(spec.groups, "url_selectors", lambda s: _links_of("dom", s))
    once = with_once(parsed, "trees", trees)
    rows = once.select("base_url", "trees", F.inline("wanted_by"))
    return rows.select(
        "group_id", "seed_pos", "base_url", F.posexplode(links).alias("link_pos", "href")
    )


@per_application
def _absolute(href: str, base: str) -> Column:
    return absolute_url(F.col(href), F.col(base))


@per_application
def _valid(url: str, strict: bool) -> Column:
    return is_valid_url(F.col(url), strict)


def absolute_links(links: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``abs_url`` and keep the valid ones."""
    full = with_once(links, "abs_url", _absolute("href", "base_url"))
    return full.filter(_valid("abs_url", strict))


#: A page has fewer links than this, and a run fewer than 5 * 10^8 groups; more are refused by an overflow.
_LINKS, _SEEDS = 10**10, 2 * 10**29


def packed(seed_pos: str, link_pos: str, group_id: str | None = None) -> Column:
    """A place in discovery order as one number, of which minima and maxima hash; seeds may have any 64-bit position."""
    number = lambda c: F.col(c).cast("decimal(20,0)")
    place = (number(seed_pos) * F.lit(_LINKS).cast("decimal(11,0)")).cast("decimal(30,0)") + number(link_pos)
    if group_id is not None:
        place = place + (F.col(group_id).cast("decimal(10,0)") * F.expr(f"cast({_SEEDS} as decimal(30,0))")).cast("decimal(38,0)")
    return place.cast("decimal(38,0)")


def distinct_links(links: DataFrame) -> DataFrame:
    """One row per group and URL, at the first place it was found.

    The place is packed into one number, so the aggregate hashes (a minimum
    over a struct would sort), and each task reduces its links before the
    shuffle.
    """
    first = links.groupBy("group_id", "abs_url").agg(F.min(packed("seed_pos", "link_pos")).alias("place"))
    size = F.lit(_LINKS).cast("decimal(11,0)")
    link = F.pmod("place", size)
    return first.select(
        "group_id",
        ((F.col("place") - link) / size).cast("bigint").alias("seed_pos"),
        link.cast("int").alias("link_pos"),
        "abs_url",
    )


def cap_links(links: DataFrame, limit: int | None, bucket: int = 4096) -> DataFrame:
    """The first ``limit`` links of each group in discovery order (at least one).

    A rank is the number of links on earlier seeds plus the rank within the
    page.  The first part comes from counts, summed over buckets of seeds and
    then within a bucket, so no task holds all links, or all seeds, of a group,
    however large it is.  Seeds beyond the limit are dropped before any link is
    sorted.  The links are needed several times, so they are written down first.
    """
    if limit is None:
        return links
    links = written(links)
    cap = max(limit, 1)

    def sum_before(n: str, by: list[str], order: str) -> Column:
        rows = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(rows), F.lit(0))

    counts = (
        links.groupBy("group_id", "seed_pos")
        .agg(F.count("*").alias("n"))
        .withColumn("bucket", F.expr(f"(seed_pos - pmod(seed_pos, {bucket})) div {bucket}"))
    )
    buckets = (
        counts.groupBy("group_id", "bucket")
        .agg(F.sum("n").alias("n"))
        .select(
            "group_id", "bucket", sum_before("n", ["group_id"], "bucket").alias("before_bucket")
        )
        .filter(F.col("before_bucket") < cap)
    )
    before = F.col("before_bucket") + sum_before("n", ["group_id", "bucket"], "seed_pos")
    wanted = (
        counts.join(buckets, ["group_id", "bucket"])
        .select("group_id", "seed_pos", before.alias("before"))
        .filter(F.col("before") < cap)
    )
    in_page = W.partitionBy("group_id", "seed_pos").orderBy("link_pos")
    return (
        links.join(wanted, ["group_id", "seed_pos"])
        .withColumn("in_page", F.row_number().over(in_page))
        .filter(F.col("before") + F.col("in_page") <= cap)
        .select(*links.columns)
    )


def discover(
    pages: DataFrame,
    spec: Spec,
    seen: DataFrame | None = None,
    limit: int | None = None,
    as_of: Column | datetime | None = None,
    strict: bool = True,
    start: DataFrame | None = None,
) -> DataFrame:
    """``(group_id, seed_pos, link_pos, abs_url)`` to fetch.

    Valid, distinct per group, not seen, capped per group: cheap filters come
    before anything touches an article page.  ``start`` replaces the seed URLs
    of the spec by a table ``(group_id, seed_pos, base_url)``.
    """
    start = seeds(pages.sparkSession, spec, strict) if start is None else group_seeds(start.filter(_valid("base_url", strict)))
    # written, since they are read several times
    start = written(start)
    listing = latest_copy(start, "base_url", pages)
    links = distinct_links(absolute_links(page_links(listing, spec), strict))
    return cap_links(unseen(links, seen, as_of), limit)
