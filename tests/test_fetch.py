"""Which copy of a page is fetched, and what moves on the way."""

import re

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import fetch
from pagequarry.operators.articles import fetch_join
from pagequarry.operators.fetch import bloom_filter, filter_size, has_places, latest_copy, may_hold
from pagequarry.operators.links import cap_links, distinct_links
from pagequarry.sources.pages import save_bucketed, spread

LINKS = "group_id int, seed_pos bigint, link_pos int, abs_url string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """2,000 pages; those with a number divisible by 3 have older copies, by 5 null ids, by 7 ties."""
    at = str(tmp_path_factory.mktemp("pages") / "rows")
    url = F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url")
    html = lambda kind: F.concat(F.lit(f"<h1>{kind} "), F.col("id").cast("string")).alias("html")
    ids = spark.range(2000)
    rows = ids.select((F.col("id") + 10_000).alias("page_id"), url, html("new"))
    rows = rows.unionByName(ids.where("id % 3 = 0").select(F.col("id").alias("page_id"), url, html("old")))
    rows = rows.unionByName(ids.where("id % 5 = 0").select(F.lit(None).cast("bigint").alias("page_id"), url, html("none")))
    rows = rows.unionByName(ids.where("id % 7 = 0").select((F.col("id") + 10_000).alias("page_id"), url, html("tie")))
    rows = rows.unionByName(ids.where("id % 14 = 0").select((F.col("id") + 10_000).alias("page_id"), url, html("tie")))
    rows.repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def wanted(spark):
    """Every fourth page, and some that nobody has."""
    return spark.createDataFrame([(f"http://h/{4 * i}", i) for i in range(600)], "u string, place long")


def plain(stored, wanted):
    best = {}
    for r in stored.withColumn("h", F.xxhash64("html")).collect():
        key = (r.page_id is not None, r.page_id or 0, -r.h)
        if r.url not in best or key > best[r.url][0]:
            best[r.url] = (key, r.html)
    return sorted((r.u, r.place, best[r.u][1]) for r in wanted.collect() if r.u in best)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [10_000, 0])
@pytest.mark.parametrize("error", [0.01, 0.5])
def test_the_copy_that_counts(spark, stored, wanted, monkeypatch, most, error):
    """The same with and without a broadcast, at any rate of errors of the filter."""
    monkeypatch.setattr(fetch, "BROADCAST_LINKS", most)
    found = latest_copy(wanted, "u", stored, error)
    assert found.columns == ["html", "u", "place"]
    assert sorted((r.u, r.place, r.html) for r in found.collect()) == plain(stored, wanted)


def test_pages_of_no_files_and_without_ids(spark, stored, wanted):
    union = stored.where("page_id is null").unionByName(stored.where("page_id is not null"))
    assert not has_places(union) and has_places(spread(stored)) and has_places(stored.where("url > 'a'").select("url"))
    assert sorted((r.u, r.place, r.html) for r in latest_copy(wanted, "u", union).collect()) == plain(stored, wanted)
    got = {r.u: r.html for r in latest_copy(wanted, "u", stored.drop("page_id")).collect()}
    least = stored.withColumn("h", F.xxhash64("html")).groupBy("url").agg(F.min_by("html", "h").alias("html"))
    want = {r.url: r.html for r in least.collect()}
    assert got == {u: want[u] for u in got} and len(got) == 500
    assert latest_copy(wanted.limit(0), "u", stored).collect() == []
    assert latest_copy(wanted, "u", stored.limit(0)).collect() == []


def test_html_is_not_sorted_and_unlinked_pages_stay(spark, stored, wanted, monkeypatch):
    monkeypatch.setattr(fetch, "BROADCAST_LINKS", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = latest_copy(wanted, "u", stored)
        plan = plan_of(found)
        assert "Window" not in plan and "SortMergeJoin" not in plan and not re.search(r"\bSort \[", plan)
        rows = found.count()
        assert rows == 500
        # what reaches the exchange of the pages: those asked for, in all their copies, and few errors
        bloom = bloom_filter(wanted, "u", 600)
        passed = stored.where(may_hold(bloom, F.col("url"), 600))
        asked = stored.join(wanted, stored["url"] == wanted["u"], "left_semi").count()
        unasked = stored.count() - asked
        assert asked <= passed.count() <= asked + max(1, 0.03 * unasked)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_filter_has_no_false_negatives_at_any_size(spark):
    values = spark.range(5000).select(F.col("id").cast("string").alias("v"))
    for most in (1 << 15, 1 << 18):
        bloom = bloom_filter(values, "v", 5000, 0.01, most)
        assert bloom.count() == 1
        assert values.where(may_hold(bloom, F.col("v"), 5000, 0.01, most)).count() == 5000
        others = spark.range(10_000, 30_000).select(F.col("id").cast("string").alias("v"))
        passed = others.where(may_hold(bloom, F.col("v"), 5000, 0.01, most)).count()
        assert passed < 20_000 * (0.02 if most == 1 << 18 else 0.2)
    assert filter_size(10**9)[0] == fetch.MOST_BITS and filter_size(0)[0] == 64 * 512


def test_bucketed_pages_stay_where_they_are(spark, stored, wanted, tmp_path, monkeypatch):
    save_bucketed(stored, "kept_pages", 4, f"{tmp_path}/pages")
    monkeypatch.setattr(fetch, "BROADCAST_LINKS", 0)
    links = wanted.select(F.lit(0).alias("group_id"), F.col("place").alias("seed_pos"), F.lit(1).alias("link_pos"), F.col("u").alias("abs_url"))
    try:
        joined = fetch_join(links, spark.table("kept_pages"))
        plan = plan_of(joined)
        assert plan.count("Exchange hashpartitioning") == 1 and "ShuffledHashJoin" in plan
        assert joined.count() == 500
    finally:
        spark.sql("DROP TABLE kept_pages")


def test_places_of_any_seed(spark):
    """Negative seeds, those at the ends of 64 bits, and large groups keep their order."""
    seeds = [-(1 << 63), -5, -1, 0, 3, (1 << 63) - 1]
    rows = [(g, s, k, f"u{k % 3}") for g in (0, 400_000_000) for s in reversed(seeds) for k in (7, 2, 9_999, 2**31 - 1)]
    links = spark.createDataFrame(rows, LINKS)
    want = {}
    for g, s, k, u in rows:
        want[g, u] = min(want.get((g, u), (s, k)), (s, k))
    got = {(r.group_id, r.abs_url): (r.seed_pos, r.link_pos) for r in distinct_links(links).collect()}
    assert got == want
    small = spark.createDataFrame([(0, s, k, f"{s} {k}") for s in range(-9000, 9000, 1500) for k in (0, 1)], LINKS)
    capped = [(r.seed_pos, r.link_pos) for r in cap_links(small, 5).orderBy("seed_pos", "link_pos").collect()]
    assert capped == [(-9000, 0), (-9000, 1), (-7500, 0), (-7500, 1), (-6000, 0)]
