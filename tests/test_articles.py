import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagequarry.operators.articles import domain_counts, done_message, fetch_join, unique_ids
from pagequarry.operators.fetch import latest_copy
from pagequarry.sources.lineage import written
from pagequarry.operators.links import seeds
from pagequarry.plans.runs import merged, run, run_all, scrape
from pagequarry.plans.spec import Spec
from pagequarry.sources import sinks
from pagequarry.sources.pages import save_bucketed
from pagequarry.sources.seen_store import SEEN_STORES, SeenFiles
from pagequarry.streaming.continuous import run_stream, stream_pages
from pagequarry.operators.extract import extract
from pagequarry.plans.spec import parse_selector

NOW = datetime(2024, 1, 10, 12)
SPEC = {
    "version": "1.0.0",
    "pages": [
        {
            "metadata": {"site": "h"},
            "urls": ["http://h.com/list"],
            "url_selectors": {
                "key": "l", "selector": "a", "select": "all",
                "extract": {"type": "attribute", "key": "href"},
            },
            "selectors": {"key": "t", "selector": "h1"},
        },
        {
            "urls": ["http://h.com/list"],
            "url_selectors": {
                "key": "l", "selector": "a", "select": "all",
                "extract": {"type": "attribute", "key": "href"},
            },
            "selectors": {"key": "p", "selector": "p", "select": "all"},
        },
    ],
}
PAGES = [
    (0, "http://h.com/list", "<html><a href='/a'></a><a href='/b'></a><a href='/c'></a><a href='/gone'></a></html>"),
    (1, "http://h.com/a", "<html><h1>A</h1><p>1</p><p>2</p></html>"),
    (2, "http://h.com/b", "<html><h1>A</h1></html>"),
    (3, "http://h.com/c", "<html><p>x \"q\" é</p></html>"),
]
ARTICLE = "metadata string, id string, url string, scrape_time timestamp, components string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")


def articles(spark, rows):
    data = [(None, i, u, NOW + timedelta(seconds=n), json.dumps({"k": i})) for n, (i, u) in enumerate(rows)]
    return spark.createDataFrame(data, ARTICLE)


def test_scrape(pages):
    rows = scrape(Spec.from_dict(SPEC), pages, as_of=NOW).collect()
    got = {(r.found_at.group_id, r.url): (r.metadata, json.loads(r.components)) for r in rows}
    meta = '{"site": "h"}'
    assert got == {
        (0, "http://h.com/a"): (meta, {"t": "A"}),
        (0, "http://h.com/b"): (meta, {"t": "A"}),
        (1, "http://h.com/a"): (None, {"p": ["1", "2"]}),
        (1, "http://h.com/c"): (None, {"p": ['x "q" é']}),
    }
    ids = {(r.found_at.group_id, r.url): r.id for r in rows}
    # same domain and same content: same id
    assert ids[0, "http://h.com/a"] == ids[0, "http://h.com/b"] != ids[1, "http://h.com/a"]
    assert {r.scrape_time for r in rows} == {NOW}


def test_run_all_keeps_one_article_per_id(pages):
    spec = Spec.from_dict(SPEC)
    rows = run_all([spec, spec], pages, as_of=NOW).collect()
    assert sorted(r.url for r in rows) == ["http://h.com/a", "http://h.com/a", "http://h.com/c"]
    assert len({r.id for r in rows}) == 3


def test_second_run_admits_nothing(spark, pages, tmp_path):
    spec = Spec.from_dict(SPEC)
    targets = [
        ("file", {"path": f"{tmp_path}/files"}),
        ("keyed", {"path": f"{tmp_path}/keyed"}),
        ("log", {"path": f"{tmp_path}/log"}),
        ("noop", {}),
        ("broken", {}),
    ]

    @sinks.register_sink("broken")
    def broken(df, run_id="0"):
        raise RuntimeError("down")

    first = run(spark, spec, pages, as_of=NOW, sinks=targets, notify=("file", {"path": f"{tmp_path}/done"}), run_id="1")
    assert [k for k, e in first.outcome.items() if e is not None] == ["broken"]
    first.seen.write.parquet(f"{tmp_path}/seen")
    seen = spark.read.parquet(f"{tmp_path}/seen")
    assert {r.url for r in seen.collect()} == {f"http://h.com/{x}" for x in "abc"}

    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    assert spark.read.parquet(f"{tmp_path}/keyed").count() == 3
    files = {r.file_key: json.loads(r.article) for r in sinks.read_files(spark, f"{tmp_path}/files").collect()}
    assert set(files) == {"h.com_a.json", "h.com_b.json", "h.com_c.json"}
    # the second group comes later and overwrites the first
    assert files["h.com_a.json"]["components"] == {"p": ["1", "2"]}
    assert list(files["h.com_b.json"]) == ["metadata", "id", "url", "scrape_time", "components"]
    done = spark.read.json(f"{tmp_path}/done").collect()
    assert sum(len(json.loads(r.done)) for r in done) == 3

    again = run(spark, spec, pages, seen, as_of=NOW + timedelta(days=1), sinks=targets, notify=("file", {"path": f"{tmp_path}/done"}), run_id="2")
    assert again.articles.count() == 0
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    assert spark.read.json(f"{tmp_path}/done").count() == len(done)
    later = scrape(spec, pages, seen, as_of=NOW + timedelta(weeks=1))
    assert later.count() == 4


def test_repeated_run_replaces_its_output(spark, tmp_path):
    df = articles(spark, [("1", "http://h.com/a"), ("2", "http://h.com/b")])
    for _ in range(2):
        sinks.append_log(df, f"{tmp_path}/log", run_id="7")
        sinks.insert_if_absent(df, f"{tmp_path}/keyed", run_id="7")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    assert spark.read.parquet(f"{tmp_path}/keyed").count() == 2


def test_file_sink_ignores_the_query(spark, tmp_path):
    path = f"{tmp_path}/files"
    sinks.write_files(articles(spark, [("1", "http://h.com/a?x=1"), ("2", "http://h.com/a?x=2")]), path, "1")
    assert json.loads(sinks.read_files(spark, path).collect()[0].article)["id"] == "2"
    later = articles(spark, [("3", "http://h.com/a#z")]).withColumn("scrape_time", F.lit(NOW + timedelta(days=1)))
    sinks.write_files(later, path, "2")
    rows = sinks.read_files(spark, path).collect()
    assert len(rows) == 1 and json.loads(rows[0].article)["id"] == "3"


def test_keyed_sink_keeps_the_first(spark, tmp_path):
    path = f"{tmp_path}/keyed"
    sinks.insert_if_absent(articles(spark, [("1", "http://h.com/a"), ("1", "http://h.com/b")]), path, "1")
    sinks.insert_if_absent(articles(spark, [("1", "http://h.com/c"), ("2", "http://h.com/d")]), path, "2")
    got = {r._id: r.url for r in spark.read.parquet(path).collect()}
    assert got == {"1": "http://h.com/a", "2": "http://h.com/d"}


def test_log_skips_null_articles(spark):
    df = articles(spark, [("1", "http://h.com/a")])
    null = df.withColumn("components", F.lit(None).cast("string"))
    assert sinks.log_entries(df.unionByName(null)).count() == 1


def test_done_message(spark):
    df = articles(spark, [("b", "u"), ("a", "u"), ("b", "v")])
    assert sorted(r.done for r in done_message(df).collect()) == ['[{"id":"a"}]', '[{"id":"b"}]']
    assert done_message(df.filter("id = 'x'")).count() == 0
    many = articles(spark, [(str(i), "u") for i in range(900)])
    parts = [json.loads(r.done) for r in done_message(many).collect()]
    assert 1 < len(parts) <= 256 and sorted(x["id"] for p in parts for x in p) == sorted(str(i) for i in range(900))


def test_counts_and_unique_ids(spark):
    df = articles(spark, [("a", "http://x.com/1"), ("a", "http://x.com/2"), ("b", "http://y.com/")])
    assert {(r.domain, r.n_articles) for r in domain_counts(df).collect()} == {("x.com", 1), ("y.com", 1)}
    assert {(r.id, r.url) for r in unique_ids(df).collect()} == {("a", "http://x.com/1"), ("b", "http://y.com/")}


def test_stream_equals_batch(spark, pages, tmp_path):
    spec = Spec.from_dict(SPEC)
    src, out = f"{tmp_path}/in", f"{tmp_path}/log"
    pages.coalesce(1).write.parquet(src)

    def go():
        q = run_stream(
            spec, stream_pages(spark, src), SeenFiles(f"{tmp_path}/seen"), f"{tmp_path}/cp",
            [("log", {"path": out})], notify=("file", {"path": f"{tmp_path}/done"}), as_of=NOW,
        )
        q.awaitTermination()

    go()
    batch = sinks.log_entries(scrape(spec, pages, as_of=NOW)).collect()
    streamed = spark.read.parquet(out).select("key", "value").collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))
    # the same pages again: everything was seen
    pages.coalesce(1).write.mode("append").parquet(src)
    go()
    assert spark.read.parquet(out).count() == len(batch)
    assert len(os.listdir(f"{tmp_path}/done")) == 1


@pytest.mark.parametrize("order", ["abcl", "labc", "alcb"])
def test_any_split_of_a_stream_equals_batch(spark, pages, tmp_path, order):
    spec, src, out = Spec.from_dict(SPEC), f"{tmp_path}/in", f"{tmp_path}/log"

    def go():
        q = run_stream(
            spec, stream_pages(spark, src, 1), SeenFiles(f"{tmp_path}/seen"), f"{tmp_path}/cp", [("log", {"path": out})], as_of=NOW
        )
        q.awaitTermination()

    for letter in order:
        pages.filter(F.col("url").endswith(letter if letter != "l" else "list")).coalesce(1).write.mode("append").parquet(src)
        go()
    pages.filter(~F.col("url").rlike("(a|b|c|list)$")).coalesce(1).write.mode("append").parquet(src)
    go()
    batch = sinks.log_entries(scrape(spec, pages, as_of=NOW)).collect()
    streamed = spark.read.parquet(out).select("key", "value").collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))


def test_runs_without_an_id_add_up(spark, pages, tmp_path):
    spec, store = Spec.from_dict(SPEC), SEEN_STORES["table"](f"{tmp_path}/seen")
    targets = [("log", {"path": f"{tmp_path}/log"}), ("file", {"path": f"{tmp_path}/files"})]
    first = run(spark, spec, pages, as_of=NOW, sinks=targets, seen_store=store)
    again = run(spark, spec, pages, as_of=NOW + timedelta(hours=1), sinks=targets, seen_store=store)
    assert first.run_id < again.run_id and again.articles.count() == 0
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    assert store.read(spark).count() == 3
    assert sinks.read_files(spark, f"{tmp_path}/files").count() == 3


def test_repeated_keyed_run_with_digits_as_id(spark, tmp_path):
    df = articles(spark, [("1", "http://h.com/a"), ("2", "http://h.com/b")])
    for _ in range(3):
        assert {r.id for r in sinks.insert_if_absent(df, f"{tmp_path}/k", run_id="007").collect()} == {"1", "2"}
    assert {r.id for r in sinks.insert_if_absent(df, f"{tmp_path}/k", run_id="8").collect()} == set()
    assert spark.read.parquet(f"{tmp_path}/k").count() == 2


def test_notice_lists_only_what_was_stored(spark, pages, tmp_path):
    sinks.register_sink("broken")(_broken)
    done = ("file", {"path": f"{tmp_path}/done"})
    r = run(spark, Spec.from_dict(SPEC), pages, as_of=NOW, sinks=[("broken", {})], notify=done)
    assert r.stored.count() == 0 and not os.path.exists(f"{tmp_path}/done")
    keyed = ("keyed", {"path": f"{tmp_path}/keyed"})
    run(spark, Spec.from_dict(SPEC), pages, as_of=NOW, sinks=[keyed], notify=done)
    second = run(spark, Spec.from_dict(SPEC), pages, as_of=NOW, sinks=[keyed, ("broken", {})], notify=done)
    assert second.stored.count() == 0 and len(os.listdir(f"{tmp_path}/done")) == 1


def _broken(df, run_id=None):
    raise RuntimeError("down")


def test_several_specs_in_one_pass(spark, pages, tmp_path):
    spec = Spec.from_dict(SPEC)
    r = run(spark, [spec, spec], pages, as_of=NOW, sinks=[("log", {"path": f"{tmp_path}/log"})])
    assert r.articles.count() == r.stored.count() == 3
    plans = [scrape(s, pages, as_of=NOW)._jdf.queryExecution().executedPlan().toString() for s in (spec, merged([spec] * 3))]
    assert plans[0].count("Scan parquet") == plans[1].count("Scan parquet")


def test_latest_copy_of_a_page_counts(spark, pages):
    spec = Spec.from_dict(SPEC)
    now = pages.withColumn("page_id", F.lit(2).cast("long"))
    old = now.select("url", F.lit("<a href='/zzz'>x</a><h1>old</h1><p>old").alias("html"), F.lit(1).cast("long").alias("page_id"))
    want = scrape(spec, pages, as_of=NOW).select("id", "url").collect()
    got = scrape(spec, old.unionByName(now), as_of=NOW).select("id", "url").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_seeds_of_a_spec_do_not_shuffle_the_html(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages")
    stored = spark.read.parquet(f"{tmp_path}/pages")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = latest_copy(written(seeds(spark, Spec.from_dict(SPEC))), "base_url", stored)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_winners_are_found_without_sorting_records(spark, pages):
    found = scrape(Spec.from_dict(SPEC), pages, as_of=NOW)
    for df in (unique_ids(found), sinks.last_per_file(found), sinks.absent(found, None)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_extraction_on_a_stream(spark, pages, tmp_path):
    src = f"{tmp_path}/in"
    pages.write.parquet(src)
    stream = extract(stream_pages(spark, src, 1), parse_selector({"key": "t", "selector": "h1"}), as_json=True)
    q = (
        stream.writeStream.format("memory").queryName("extracted").outputMode("append")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = {r.url: r.components for r in spark.table("extracted").collect()}
    assert got["http://h.com/a"] == '{"t":"A"}' and got["http://h.com/c"] is None


@pytest.mark.parametrize("kind", ["file", "table"])
def test_seen_store(spark, pages, tmp_path, kind):
    store = SEEN_STORES[kind](f"{tmp_path}/seen")
    spec = Spec.from_dict(SPEC)

    def count(run_id, when):
        r = run(spark, spec, pages, as_of=when, seen_store=store, run_id=run_id)
        return r.articles.count()

    assert store.read(spark) is None
    assert count("1", NOW) == 4
    assert count("1", NOW) == 4  # a repeated run does not see its own entries
    assert count("2", NOW + timedelta(days=1)) == 0
    assert count("3", NOW + timedelta(days=8)) == 4
    assert {r.expiration_date for r in store.read(spark).collect()} == {NOW + timedelta(days=15)}
    fresh = store.compact(spark, f"{tmp_path}/compact", NOW + timedelta(days=15))
    assert fresh.read(spark).count() == 0
    assert SEEN_STORES["noop"]().read(spark) is None
