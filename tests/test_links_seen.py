import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import seen
from pagequarry.operators.links import cap_links, discover, seeds
from pagequarry.operators.seen import mark_seen, prune, ttl_admit, unseen
from pagequarry.plans.spec import Spec
from pagequarry.sources.pages import decode_pages, read_raw_files, read_seen_lines, write_seen_lines

NOW = datetime(2024, 1, 10, 12)
LINKS = {"key": "l", "selector": "a", "select": "all", "extract": {"type": "attribute", "key": "href"}}


def spec(*groups):
    pages = [
        {"urls": urls, "url_selectors": links, "selectors": {"key": "t", "selector": "p"}}
        for urls, links in groups
    ]
    return Spec.from_dict({"version": "1.0.0", "pages": pages})


def html(*hrefs):
    return "<html>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        ("http://h.com/l1", html("/a", "/b", "/a", "c?x=1#f", "http://o.com/z?q", "#top", "ftp://x/y")),
        ("http://h.com/l2", html("/b", "/d", "/e")),
        ("http://h.com/bad", html("/ok", "http://[x/", "/lost")),
        ("http://h.com/none", "<p>no root</p>"),
    ]
    return spark.createDataFrame(rows, "url string, html string")


def urls(df):
    return [r.abs_url for r in df.orderBy("group_id", "seed_pos", "link_pos").collect()]


def test_discover(spark, pages):
    s = spec((["http://h.com/l1", "http://h.com/l2", "http://localhost/x", "http://gone.com/"], LINKS))
    assert urls(discover(pages, s)) == [
        "http://h.com/a", "http://h.com/b", "http://h.com/c", "http://o.com/z?q", "http://h.com/y",
        "http://h.com/d", "http://h.com/e",
    ]
    assert seeds(spark, s).count() == 3
    again = spec((["http://h.com/l1"] * 2, LINKS), (["http://h.com/l2", "http://h.com/l1"], LINKS))
    by = {r.base_url: sorted(map(tuple, r.wanted_by)) for r in seeds(spark, again).collect()}
    assert by == {"http://h.com/l1": [(0, 0), (1, 1)], "http://h.com/l2": [(1, 0)]}


def test_malformed_link_ends_its_page(pages):
    s = spec((["http://h.com/bad", "http://h.com/none", "http://h.com/l2"], LINKS))
    assert urls(discover(pages, s))[0] == "http://h.com/ok"
    assert "http://h.com/lost" not in urls(discover(pages, s))
    assert len(urls(discover(pages, s))) == 4


def test_other_link_shapes(pages):
    chain = {"key": "k", "selector": "html", "child": LINKS}
    one = {**LINKS, "select": "first"}
    body = {"key": "k", "selector": "a", "child": {**one, "include_self": True, "selector": "a"}}
    s = spec((["http://h.com/l1"], chain), (["http://h.com/l2"], one), (["http://h.com/l2"], body))
    assert urls(discover(pages, s)) == ["http://h.com/b", "http://h.com/b"]


@pytest.mark.parametrize("limit, want", [(0, 2), (1, 2), (3, 6), (5, 8), (None, 10)])
def test_limit_is_per_group(pages, limit, want):
    both = ["http://h.com/l1", "http://h.com/l2"]
    s = spec((both, LINKS), (["http://h.com/l2"], LINKS))
    got = discover(pages, s, limit=limit)
    assert got.count() == want


def test_cap_against_sorting(spark):
    rnd = random.Random(5)
    rows = sorted({(rnd.choice([0, 0, 0, 1, 2]), rnd.randint(0, 9), rnd.randint(0, 40)) for _ in range(400)})
    df = spark.createDataFrame(rows, "group_id int, seed_pos int, link_pos int")
    for limit in (1, 7, 60, 1000):
        want = [r for g in range(3) for r in [x for x in rows if x[0] == g][:limit]]
        assert sorted(tuple(r) for r in cap_links(df, limit).collect()) == want
        assert sorted(tuple(r) for r in cap_links(df, limit, bucket=3).collect()) == want


def test_seen_filter_and_prune(spark, pages):
    seen = spark.createDataFrame(
        [
            ("http://h.com/a", NOW + timedelta(seconds=1)),
            ("http://h.com/b", NOW),
            ("http://h.com/d", NOW - timedelta(days=1)),
        ],
        "url string, expiration_date timestamp_ntz",
    )
    s = spec((["http://h.com/l1", "http://h.com/l2"], LINKS))
    left = urls(discover(pages, s, seen=seen, as_of=NOW))
    assert "http://h.com/a" not in left and {"http://h.com/b", "http://h.com/d"} <= set(left)
    # the seen filter comes before the limit
    assert urls(discover(pages, s, seen=seen, as_of=NOW, limit=2)) == ["http://h.com/b", "http://h.com/c"]
    assert [r.url for r in prune(seen, NOW).collect()] == ["http://h.com/a"]
    assert unseen(left := discover(pages, s), None) is left


def test_mark_seen_renews_and_clamps(spark):
    old = spark.createDataFrame(
        [("a", NOW + timedelta(days=30)), ("b", NOW)], "url string, expiration_date timestamp_ntz"
    )
    new = spark.createDataFrame([("a",), ("a",), ("c",)], "url string")
    got = {r.url: r.expiration_date for r in mark_seen(old, new, timedelta(days=1), NOW).collect()}
    assert got == {"a": NOW + timedelta(days=1), "b": NOW, "c": NOW + timedelta(days=1)}
    late = mark_seen(None, new, timedelta(days=900_000_000 // 250), datetime(9999, 1, 1)).collect()
    assert {r.expiration_date for r in late} == {datetime(9999, 12, 31, 23, 59, 59, 999999)}


def admitted(times, ttl):
    out = []
    for t in sorted(set(times)):
        if not out or out[-1] + ttl <= t:
            out.append(t)
    return out


@pytest.mark.parametrize("fold_limit", [0, 50, 10_000])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_ttl_admit(spark, fold_limit, kind):
    rnd = random.Random(11)
    start = datetime(2024, 3, 30, 22)
    rows = [("hot", start + timedelta(seconds=rnd.randint(0, 90_000))) for _ in range(600)]
    rows += [(f"k{i % 9}", start + timedelta(seconds=rnd.choice([0, 600, 1200, 1800, 86_400]))) for i in range(60)]
    ttl = timedelta(minutes=10)
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz").withColumn("ts", F.col("ts").cast(kind))
    got = sorted((r.k, r.ts) for r in ttl_admit(df, "k", "ts", ttl, fold_limit).collect())
    keys = {k for k, _ in rows}
    want = sorted((k, t) for k in keys for t in admitted([x for y, x in rows if y == k], ttl))
    assert got == want


def test_seen_lines(spark, tmp_path):
    lines = [("a", "2024-01-01T00:00:00"), ("b", "2024-01-02T00:00:00.5"), ("a", "2024-01-03T00:00:00")]
    good = tmp_path / "seen.json"
    good.write_text("".join(json.dumps({"url": u, "expiration_date": e}) + "\n" for u, e in lines))
    got = {r.url: r.expiration_date for r in read_seen_lines(spark, str(good)).collect()}
    assert got == {"a": datetime(2024, 1, 3), "b": datetime(2024, 1, 2, 0, 0, 0, 500000)}
    write_seen_lines(read_seen_lines(spark, str(good)), str(tmp_path / "out"))
    again = {r.url: r.expiration_date for r in read_seen_lines(spark, str(tmp_path / "out")).collect()}
    assert again == got
    for bad in ("{broken\n", '{"url": "a"}\n', '{"expiration_date": "2024-01-01"}\n'):
        f = tmp_path / "bad.json"
        f.write_text(bad)
        with pytest.raises(Exception):
            read_seen_lines(spark, str(f)).collect()


def test_raw_pages(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>é</p>".encode())
    (tmp_path / "b.html").write_bytes(b"<p>\xff</p>")
    got = decode_pages(read_raw_files(spark, str(tmp_path))).collect()
    assert [r.html for r in got] == ["<p>é</p>"] and got[0].url.endswith("a.html")


@pytest.mark.parametrize("ttl", [1, 7, 40, 1000])
def test_ttl_runs_of_cells(spark, monkeypatch, ttl):
    """Only visits less than a TTL apart meet in chains, at times before 1970 too, in as many tasks as they need."""
    rnd = random.Random(ttl)
    start = datetime(1969, 12, 31, 23, 59, 59)
    rows = [(f"k{i % 3}", start + timedelta(microseconds=rnd.randint(0, 3_000_000) // 25 * 25)) for i in range(400)]
    rows += [("k0", start + timedelta(microseconds=i * ttl * 1000)) for i in range(40)]
    chained, real = [], seen._successors
    monkeypatch.setattr(seen, "_successors", lambda v, *a: chained.append(v.count()) or real(v, *a))
    monkeypatch.setattr(seen, "TASK_ROWS", 100)
    width = timedelta(milliseconds=ttl)
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    got = sorted((r.k, r.ts) for r in ttl_admit(df, "k", "ts", width, 1).collect())
    assert got == sorted((k, t) for k in {k for k, _ in rows} for t in admitted([x for y, x in rows if y == k], width))
    if ttl == 1:
        assert sum(chained) < len(rows) / 2
