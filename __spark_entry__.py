"""Registered queries, each with its SQL where SQL can say the same.

Every query reads whole tables.  Queries on web pages use ``pages``; tables
without URLs or dates in text get them from Spark expressions over their own
columns.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import lru_cache

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.arrays import with_once
from pagequarry.functions.dates import ZONE_MINUTES, epoch_iso, iso_date
from pagequarry.functions.jsonpath import json_matches
from pagequarry.functions.modifiers import regex_modifier
from pagequarry.functions.text import strip
from pagequarry.functions.time import instant
from pagequarry.functions.urls import absolute_url, is_valid_url, netloc, split_url
from pagequarry.operators.articles import (
    article_count,
    article_id,
    domain_counts,
    done_message,
    unique_ids,
)
from pagequarry.operators.extract import components, extract, nodes, shred_for
from pagequarry.operators.links import absolute_links, cap_links, discover, distinct_links, page_links
from pagequarry.operators.quality import broken_rules
from pagequarry.operators.seen import mark_seen, prune, ttl_admit, unseen
from pagequarry.plans.runs import merged, scrape
from pagequarry.plans.spec import Spec, parse_selector
from pagequarry.sources.generations import SeenGenerations
from pagequarry.sources.lineage import new_folder, written
from pagequarry.sources.pages import dealt, decode_pages, read_pages, spread
from pagequarry.sources.seen_store import SeenFiles
from pagequarry.sources.sinks import absent, fan_out, last_per_file, log_entries, new_run_id, register_sink
from pagequarry.streaming.continuous import run_stream, stream_pages

TAGS_ONLY: frozenset[str] = frozenset()
AS_OF = datetime(2024, 1, 20)
TTL = timedelta(days=2)

# ---------------------------------------------------------------- specs

ARTICLE = {
    "key": "article",
    "selector": "article",
    "select": "all",
    "children": [{"key": "h1", "selector": "h1"}, {"key": "p", "selector": "p", "select": "all"}],
}
HEADLINE = {"key": "h1", "selector": "article h1"}
LINKS = {
    "key": "links",
    "selector": "nav a",
    "select": "all",
    "extract": {"type": "attribute", "key": "href"},
}
SPEC = {
    "version": "1.0.0",
    "pages": [
        {
            "metadata": {"set": "demo"},
            "urls": ["http://seed.example.org/"],
            "url_selectors": LINKS,
            "selectors": {"common_selector": "headline"},
        },
        {
            "urls": ["http://seed.example.org/"],
            "url_selectors": LINKS,
            "selectors": {"key": "t", "selector": "title"},
        },
    ],
    "common_selectors": [{"name": "headline", "selector": HEADLINE}],
}


@lru_cache(maxsize=8)
def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read_pages(spark, f"{d}/pages.parquet")


@lru_cache(maxsize=64)
def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


@lru_cache(maxsize=8)
def _json_events(spark: SparkSession, d: str) -> DataFrame:
    """Events in tasks of bounded size: taking JSON apart costs far more than reading it."""
    return dealt(spark.read.parquet(f"{d}/events.parquet"), "event_id")


def _values(spark: SparkSession, d: str, **selectors: dict) -> DataFrame:
    """``page_id`` and one typed column per selector, one parse per page."""
    trees = {name: parse_selector({"key": "k", **s}) for name, s in selectors.items()}
    dom = shred_for(_pages(spark, d).select("page_id", "html"), *trees.values())
    found = F.struct(*[components("dom", t).alias(name) for name, t in trees.items()])
    return with_once(dom, "found", found).select("page_id", "found.*")


def _one(column: str, selector: dict):
    """Pages where the selector finds something, with its (string) value."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = _values(spark, d, **{column: selector})
        return df.filter(F.col(column).isNotNull())

    return query


def _changed(column: str, html, selector: dict):
    """The value of a selector on pages whose markup is changed first."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        pages = _pages(spark, d).select("page_id", html().alias("html"))
        out = extract(pages, parse_selector({"key": "k", **selector}), as_json=True)
        return out.select("page_id", F.get_json_object("components", "$.k").alias(column)).filter(F.col(column).isNotNull())

    return query


def _joined(column: str, selector: dict):
    """The same for a list value, joined to one string."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = _values(spark, d, **{column: {"select": "all", **selector}})
        return df.select("page_id", F.array_join(column, "|").alias(column)).filter(
            F.col(column).isNotNull()
        )

    return query


def _json(column: str, selector: dict):
    """A nested value as JSON text."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        pages = _pages(spark, d).select("page_id", "html")
        out = extract(pages, parse_selector(selector), as_json=True)
        return out.withColumnRenamed("components", column).filter(F.col(column).isNotNull())

    return query


# ---------------------------------------------------------------- pages


def article_components(spark: SparkSession, d: str) -> DataFrame:
    """Headline and paragraphs of every article: id, url, components."""
    out = extract(_pages(spark, d), parse_selector(ARTICLE), as_json=True)
    found = out.filter(F.col("components").isNotNull())
    return found.select(
        article_id(F.col("url"), F.col("components")).alias("id"), "url", "components"
    )


def element_counts(spark: SparkSession, d: str) -> DataFrame:
    return nodes(_pages(spark, d), wanted=TAGS_ONLY).groupBy("tag").agg(F.count("*").alias("n"))


def element_shape(spark: SparkSession, d: str) -> DataFrame:
    """Per page: elements, leaves of the tree, and its depth."""
    return (
        nodes(_pages(spark, d), wanted=TAGS_ONLY)
        .groupBy("page_id")
        .agg(
            F.count("*").alias("n_elements"),
            F.sum((F.col("n") == F.col("last")).cast("bigint")).alias("n_leaves"),
            F.max("depth").alias("max_depth"),
            F.sum((F.col("last") - F.col("n")).cast("bigint")).alias("n_pairs"),
            F.sum("depth").alias("depth_sum"),
        )
        .select("page_id", "n_elements", (F.col("n_pairs") == F.col("depth_sum")).alias("consistent"))
    )


def article_paragraph_count(spark: SparkSession, d: str) -> DataFrame:
    df = _values(spark, d, p={"selector": "article p", "select": "all"})
    return df.select("page_id", F.coalesce(F.size("p"), F.lit(0)).cast("bigint").alias("n_p"))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a listing page of group 0, in page order."""
    place = F.struct(F.lit(0).alias("group_id"), F.col("page_id").alias("seed_pos"))
    return _pages(spark, d).select(
        F.col("url").alias("base_url"), "html", F.array(place).alias("wanted_by")
    )


def _links(spark: SparkSession, d: str) -> DataFrame:
    return page_links(_listing(spark, d), Spec.from_dict(SPEC))


def page_link_rows(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select(
        F.col("seed_pos").alias("page_id"), F.col("link_pos").alias("pos"), "href"
    )


def abs_links(spark: SparkSession, d: str) -> DataFrame:
    return absolute_links(_links(spark, d)).select(
        F.col("seed_pos").alias("page_id"), F.col("link_pos").alias("pos"), "abs_url"
    )


def _by_host(spark: SparkSession, d: str) -> DataFrame:
    """Links grouped by the host of their page instead of by spec."""
    links = absolute_links(_links(spark, d))
    return distinct_links(links.withColumn("group_id", netloc(F.col("base_url"))))


def links_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _by_host(spark, d).select(
        F.col("group_id").alias("host"), "abs_url", "seed_pos", "link_pos"
    )


def links_capped(spark: SparkSession, d: str) -> DataFrame:
    return cap_links(_by_host(spark, d), 7).select(F.col("group_id").alias("host"), "abs_url")


def _seen_hosts(spark: SparkSession, d: str) -> DataFrame:
    """A seen table made of the page links: long ones expire late, short ones early."""
    links = absolute_links(_links(spark, d)).select("abs_url").distinct()
    day = (F.length("abs_url") % 30 + 1).cast("int")
    return links.select(
        F.col("abs_url").alias("url"),
        F.make_timestamp_ntz(
            F.lit(2024), F.lit(1), day, F.lit(0), F.lit(0), F.lit(0)
        ).alias("expiration_date"),
    )


def links_unseen(spark: SparkSession, d: str) -> DataFrame:
    left = unseen(_by_host(spark, d), written(_seen_hosts(spark, d)), AS_OF)
    return left.select(F.col("group_id").alias("host"), "abs_url")


def _visits(spark: SparkSession, d: str) -> DataFrame:
    """Events as visits: the user is the URL, the time the time of the store."""
    url = F.concat(F.lit("http://h.com/u/"), F.col("user_id"))
    return _table(spark, d, "events").select(url.alias("url"), "ts", "user_id", "event_type")


def seen_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Purchases renew what all other events have stored."""
    v = _visits(spark, d)
    old = mark_seen(None, v.filter(F.col("event_type") != "purchase"), TTL, stored="ts")
    return mark_seen(old, v.filter(F.col("event_type") == "purchase"), TTL, stored="ts")


def seen_prune(spark: SparkSession, d: str) -> DataFrame:
    return prune(mark_seen(None, _visits(spark, d), TTL, stored="ts"), AS_OF)


def ttl_admitted(spark: SparkSession, d: str) -> DataFrame:
    return ttl_admit(_table(spark, d, "events"), "user_id", "ts", TTL)


def ttl_admitted_large_keys(spark: SparkSession, d: str) -> DataFrame:
    """The same with every user on the path for keys too large to gather."""
    return ttl_admit(_table(spark, d, "events"), "user_id", "ts", TTL, fold_limit=0)


def ttl_latest_seen(spark: SparkSession, d: str) -> DataFrame:
    """Per URL the last expiry, whatever was admitted."""
    return mark_seen(None, _visits(spark, d), TTL, stored="ts")


# ---------------------------------------------------------------- URLs


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).select("page_id", split_url(F.col("url")).alias("u"))
    return p.select("page_id", "u.scheme", "u.netloc", "u.path")


def _host_urls(spark: SparkSession, d: str) -> DataFrame:
    """One URL per customer, with hosts of all kinds."""
    k = F.col("c_custkey")
    url = (
        F.when(k % 7 == 0, F.concat(F.lit("http://LocalHost/"), k))
        .when(k % 7 == 1, F.concat(F.lit("ftp://files.com/"), k))
        .when(k % 7 == 2, F.concat(F.lit("HTTPS://news"), k, F.lit(".com/0")))
        .when(k % 7 == 3, F.concat(F.lit("//h.com/"), k))
        .when(k % 7 == 4, F.concat(F.lit("http://h.com:"), k, F.lit("/p?q=0")))
        .when(k % 7 == 5, F.concat(F.lit("http:///"), k))
        .otherwise(F.concat(F.lit("http://h.com/"), k))
    )
    return _table(spark, d, "customer").select("c_custkey", url.alias("url"))


def valid_urls(spark: SparkSession, d: str) -> DataFrame:
    return _host_urls(spark, d).select(
        "c_custkey",
        is_valid_url(F.col("url")).alias("valid"),
        is_valid_url(F.col("url"), strict=False).alias("valid_loose"),
    )


def joined_links(spark: SparkSession, d: str) -> DataFrame:
    """Relative links of all kinds, joined to a base."""
    k = F.col("p_partkey")
    href = (
        F.when(k % 8 == 0, F.concat(F.lit("/p"), k, F.lit("?q=1#f")))
        .when(k % 8 == 1, F.concat(F.lit("c"), k))
        .when(k % 8 == 2, F.concat(F.lit("../d"), k))
        .when(k % 8 == 3, F.concat(F.lit("//o.com/p"), k))
        .when(k % 8 == 4, F.concat(F.lit("mailto:x"), k, F.lit("@y")))
        .when(k % 8 == 5, F.concat(F.lit("https://o.com/p?q="), k))
        .when(k % 8 == 6, F.concat(F.lit("./e/../"), k, F.lit("/.")))
        .otherwise(F.concat(F.lit("?q="), k))
    )
    base = F.lit("http://h.com/a/b?x=1")
    return _table(spark, d, "part").select("p_partkey", absolute_url(href, base).alias("abs_url"))


# ---------------------------------------------------------------- modifiers


def _modified(spark: SparkSession, d: str, patterns: list[str], returns: str) -> DataFrame:
    """Documents with a match; the value is computed once, then filtered."""
    docs = _table(spark, d, "documents").select("doc_id", "text")
    value = regex_modifier(F.col("text"), patterns, returns)
    return with_once(docs, "value", value).filter(F.col("value").isNotNull())


def regex_original(spark: SparkSession, d: str) -> DataFrame:
    kept = _modified(spark, d, ["[0-9]{3}-[0-9]{4}", "@[a-z]+\\.", "Copyright"], "original")
    return kept.select("doc_id", F.length("value").cast("bigint").alias("n"))


def regex_first(spark: SparkSession, d: str) -> DataFrame:
    patterns = ["[a-zA-Z0-9.]+@[a-z.]+", "[0-9]+", "[A-Z][a-z]+"]
    return _modified(spark, d, patterns, "first").select("doc_id", F.col("value").alias("match"))


def epoch_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates as epoch seconds or milliseconds, and back."""
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    digits = F.when(F.col("o_orderkey") % 2 == 0, seconds.cast("string")).otherwise(
        F.concat(seconds.cast("string"), F.lit("123"))
    )
    back = F.when(F.length(digits).isin(10, 13), epoch_iso(digits))
    return _table(spark, d, "orders").select("o_orderkey", back.alias("iso"))


def _date_text():
    """The order's day in one of 14 forms, with a time of day and one of the 19 zones made from its key."""
    key = F.col("o_orderkey")
    hour, minute = key % 24, key % 60
    minutes = F.make_dt_interval(hours=hour.cast("int"), mins=minute.cast("int"))
    at = F.to_timestamp_ntz(F.col("o_orderdate").cast("date").cast("string")) + minutes
    zone = F.get(F.array(*[F.lit(z) for z in sorted(ZONE_MINUTES)]), (key % len(ZONE_MINUTES)).cast("int"))
    forms = [
        ("", "d MMM yyyy HH:mm", True),
        ("", "EEE, d MMM yyyy HH:mm:ss 'GMT'", False),
        ("", "yyyy-MM-dd HH:mm", False),
        ("", "yyyy/MM/dd", False),
        ("", "yyyyMMdd", False),
        ("", "MMMM d yyyy 'at' h:mm a", True),
        ("", "yyyy-MM-dd'T'HH:mm'+03:00'", False),
        ("", "yyyy-MMM-dd", False),
        ("", "EEE MMM d HH:mm:ss yyyy", False),
        ("", "yyyyMMdd'T'HHmmss'Z'", False),
        ("", "EEE MMM dd HH:mm:ss '+0000' yyyy", False),
        ("seen ", "MMMM d, yyyy 'by a guest'", False),
        ("", "d MMMM yyyy, h:mm a 'UTC-3'", False),
        ("", "MM/dd/yyyy HH:mm", False),
    ]
    out = None
    for i, (before, pattern, with_zone) in enumerate(forms):
        parts = [F.lit(before), F.date_format(at, pattern), *([F.lit(" "), zone] if with_zone else [])]
        out = (F if out is None else out).when(key % len(forms) == i, F.concat(*parts))
    return out


def text_dates(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2024-05-15").cast("timestamp")
    return _table(spark, d, "orders").select("o_orderkey", iso_date(_date_text(), as_of).alias("iso"))


def json_scalar(spark: SparkSession, d: str) -> DataFrame:
    found = json_matches(F.col("props"), "$.k")
    return _json_events(spark, d).select("event_id", F.get(found, F.lit(0)).alias("k"))


def json_recursive(spark: SparkSession, d: str) -> DataFrame:
    """All ``k`` at any depth of a document built around the event's properties."""
    doc = F.concat(
        F.lit('{"a": '), "props", F.lit(', "b": [{"k": "'), "event_type",
        F.lit('"}, {"c": {"k": '), "event_id", F.lit("}}]}"),
    )
    return _json_events(spark, d).select(
        "event_id", F.array_join(json_matches(doc, "$..k"), ",").alias("ks")
    )


def json_repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    """Of a repeated key the last value counts; numbers that JSON does not have stand beside it."""
    events = _json_events(spark, d)
    text = F.concat(F.lit('{"a":1,"x":NaN,"a":"'), "event_type", F.lit('","y":-Infinity}'))
    return events.select("event_id", F.get(json_matches(text, "$.a"), 0).alias("a"))


def json_bad_text(spark: SparkSession, d: str) -> DataFrame:
    """Every third text is cut."""
    cut = F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return _json_events(spark, d).select("event_id", F.get(json_matches(cut, "$.k"), 0).alias("k"))


def regex_braces(spark: SparkSession, d: str) -> DataFrame:
    """JSON cut out of a script with the usual pattern, whose braces are no quantifier."""
    script = F.concat(F.lit("var p = "), "props", F.lit("; go()"))
    return _table(spark, d, "events").select("event_id", regex_modifier(script, ["{.*}"], "first").alias("json"))


def ttl_small(spark: SparkSession, d: str) -> DataFrame:
    """A millisecond, and every key taken as a large one."""
    return ttl_admit(_visits(spark, d), "url", "ts", timedelta(milliseconds=1), fold_limit=1)


def seed_listing(spark: SparkSession, d: str) -> DataFrame:
    """Links of the seeds of a spec: the first URL of each top-level domain."""
    pages = _pages(spark, d)
    domain = F.regexp_extract("url", r"^https?://[^/?#]*\.([a-z]+)", 1)
    first = [r.url for r in pages.groupBy(domain).agg(F.min("url").alias("url")).collect()]
    spec = Spec.from_dict({**SPEC, "pages": [{**SPEC["pages"][0], "urls": first}]})
    return discover(pages, spec, as_of=AS_OF).select("abs_url")


def strip_unicode(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit(" 　\t"), F.col("text"), F.lit("\n  "))
    return _table(spark, d, "documents").select(
        "doc_id", F.md5(strip(padded)).alias("digest")
    )


def utf8_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as bytes, every seventh broken; the broken ones are dropped."""
    broken = F.concat(F.lit(b"\xff\xfe"), F.encode("html", "UTF-8"))
    body = F.when(F.col("page_id") % 7 == 0, broken).otherwise(F.encode("html", "UTF-8"))
    raw = _pages(spark, d).select("page_id", body.alias("body"))
    return decode_pages(raw).select("page_id", F.length("html").cast("bigint").alias("n_chars"))


def spec_quality(spark: SparkSession, d: str) -> DataFrame:
    """One spec per part, broken in several ways; every broken rule is reported."""
    k = F.col("p_partkey") % 6
    version = F.when(k == 1, F.lit("0.9")).otherwise(F.lit("1.0.0"))
    urls = F.when(k == 2, F.lit("[]")).otherwise(F.lit('["http://h.com/"]'))
    select = F.when(k.isin(2, 3), F.lit("some")).otherwise(F.lit("all"))
    leaf = F.when(k == 4, F.lit('{"selector": "p"}')).otherwise(
        F.concat(F.lit('{"key": "'), "p_name", F.lit('", "extract": {"type": "'),
                 F.when(k == 5, F.lit("xml")).otherwise(F.lit("text")), F.lit('"}}'))
    )
    text = F.concat(
        F.lit('{"version": "'), version, F.lit('", "pages": [{"urls": '), urls,
        F.lit(', "url_selectors": {"key": "l", "select": "'), select,
        F.lit('"}, "selectors": '), leaf, F.lit("}]}"),
    )
    specs = _table(spark, d, "part").select("p_partkey", text.alias("spec"))
    return broken_rules(specs, "p_partkey", "spec").select("p_partkey", "rule")


# ---------------------------------------------------------------- articles


def _headlines(spark: SparkSession, d: str) -> DataFrame:
    """Every page as an article of its own URL."""
    selector = parse_selector(HEADLINE)
    out = extract(_pages(spark, d), selector, as_json=True)
    return out.filter(F.col("components").isNotNull()).select(
        F.lit(None).cast("string").alias("metadata"),
        article_id(F.col("url"), F.col("components")).alias("id"),
        "url",
        instant(AS_OF).alias("scrape_time"),
        "components",
        F.struct("page_id").alias("found_at"),
    )


def article_ids(spark: SparkSession, d: str) -> DataFrame:
    return unique_ids(written(_headlines(spark, d))).select("id", "url")


def article_log(spark: SparkSession, d: str) -> DataFrame:
    return log_entries(_headlines(spark, d))


def _same_files(spark: SparkSession, d: str) -> DataFrame:
    """Articles under URLs cut to the host and the first part of the path."""
    cut = F.regexp_extract("url", r"^(https?://[^/]*/[^/?#]*)", 1)
    return _headlines(spark, d).withColumn("url", F.concat(cut, F.lit("?v="), F.col("found_at.page_id")))


def file_key_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return last_per_file(written(_same_files(spark, d))).select("file_key", "url", "id")


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Articles that a target holding every third page does not have."""
    all_ = written(_headlines(spark, d))
    target = all_.filter(F.col("found_at.page_id") % 3 == 0)
    return absent(all_, target).select("id", "url")


def done(spark: SparkSession, d: str) -> DataFrame:
    return done_message(_headlines(spark, d))


def keyed_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """A keyed sink after two runs without ids: every third page first, then all."""
    path, all_ = new_folder(spark, "keyed"), written(_headlines(spark, d))
    for some in (all_.filter(F.col("found_at.page_id") % 3 == 0), all_):
        fan_out(some, [("keyed", {"path": path})])
    return spark.read.schema("id string, url string, run string").parquet(path).drop("run")


def seen_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """A seen store after two runs: even pages, then, a day later, every third one."""
    store, pages = SeenFiles(new_folder(spark, "seen")), _pages(spark, d)
    for every, at in ((2, AS_OF), (3, AS_OF + timedelta(days=1))):
        some = pages.filter(F.col("page_id") % every == 0).select("url")
        store.add(mark_seen(None, some, TTL, at), new_run_id(), at)
    return store.read(spark)


def seen_generations(spark: SparkSession, d: str) -> DataFrame:
    """A seen store of merged generations after five runs, a day apart: pages divisible by 2, then by 3, and so on."""
    store, pages = SeenGenerations(new_folder(spark, "seen"), ratio=2), _pages(spark, d)
    for k in range(5):
        at = AS_OF + timedelta(days=k)
        some = pages.filter(F.col("page_id") % (k + 2) == 0).select("url")
        store.add(mark_seen(None, some, timedelta(days=30), at), str(k), at)
    return store.read(spark)


def _down(df: DataFrame, run_id: str | None = None) -> DataFrame:
    raise RuntimeError("down")


def done_after_failures(spark: SparkSession, d: str) -> DataFrame:
    """The notice of a run of which one sink fails and the other has every third article already."""
    register_sink("down")(_down)
    path, all_ = new_folder(spark, "keyed"), written(_headlines(spark, d))
    fan_out(all_.filter(F.col("found_at.page_id") % 3 == 0), [("keyed", {"path": path})])
    return done_message(fan_out(all_, [("down", {}), ("keyed", {"path": path})]).ids)


def per_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return domain_counts(_headlines(spark, d))


def total_count(spark: SparkSession, d: str) -> DataFrame:
    return article_count(_headlines(spark, d))


def stream_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Headlines extracted from a stream of page files, read back from its sink."""
    out = new_folder(spark, "stream")
    pages = stream_pages(spark, f"{d}/pages*.parquet")
    query = (
        extract(pages, parse_selector(HEADLINE), as_json=True)
        .select("page_id", "components")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )
    query.awaitTermination()
    return spark.read.schema("page_id bigint, components string").parquet(f"{out}/rows")


def _linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages under the URL their first link points to, so that links lead somewhere."""
    first = absolute_links(_links(spark, d)).filter(F.col("link_pos") == 0)
    owner = first.groupBy("abs_url").agg(F.min("seed_pos").alias("page_id"))
    return owner.join(_pages(spark, d).select("page_id", "html"), "page_id").select(
        "page_id", F.col("abs_url").alias("url"), "html"
    )


def _start(spark: SparkSession, d: str, groups: int = 1) -> DataFrame:
    """All page URLs as seeds of every group."""
    seed = _pages(spark, d).select(
        F.col("page_id").alias("seed_pos"), F.col("url").alias("base_url")
    )
    ids = F.array(*[F.lit(i) for i in range(groups)])
    return seed.select(F.explode(ids).alias("group_id"), "seed_pos", "base_url")


_CRAWLED: dict[tuple[str, str], DataFrame] = {}


def _crawled_pages(spark: SparkSession, d: str) -> DataFrame:
    """What was fetched, written once per session: all crawls read the same pages, for links and for articles."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CRAWLED:
        _CRAWLED[key] = _fetched(spark, d)
    return _CRAWLED[key]


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    return written(_pages(spark, d).select("page_id", "url", "html").unionByName(_linked_pages(spark, d)))


def _crawl(spark: SparkSession, d: str, spec: Spec | None = None, pages: DataFrame | None = None, **kw) -> DataFrame:
    spec = spec or Spec.from_dict(SPEC)
    pages = _crawled_pages(spark, d) if pages is None else pages
    return scrape(spec, pages, as_of=AS_OF, start=_start(spark, d, 2), **kw)


def crawl_repeated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Of every page there is an older copy with other links and other text."""
    pages = _crawled_pages(spark, d)
    old = pages.select((-1 - F.col("page_id")).alias("page_id"), "url", F.lit("<h1>old</h1><nav><ul><li><a href=/old>x</a></ul></nav>").alias("html"))
    return _crawl(spark, d, pages=pages.unionByName(old)).select("metadata", "id", "url", "components")


def crawl_two_specs(spark: SparkSession, d: str) -> DataFrame:
    """The groups of the spec as two specs, in one pass, an article per id."""
    both = merged([Spec.from_dict({**SPEC, "pages": [p]}) for p in SPEC["pages"]])
    return unique_ids(written(_crawl(spark, d, both))).select("id", "url")


def stream_crawl(spark: SparkSession, d: str) -> DataFrame:
    """The crawl as a stream of three batches, so that links and their pages come apart."""
    folder = new_folder(spark, "stream")
    pages = _crawled_pages(spark, d).withColumn("third", F.pmod(F.xxhash64("url"), F.lit(3)))
    pages.repartition(3, "third").write.partitionBy("third").parquet(f"{folder}/pages")
    query = run_stream(
        Spec.from_dict(SPEC), stream_pages(spark, f"{folder}/pages/third=*", 1), SeenFiles(f"{folder}/seen"), f"{folder}/checkpoint",
        [("log", {"path": f"{folder}/log"})], as_of=AS_OF, start=_start(spark, d, 2),
    )
    query.awaitTermination()
    log = spark.read.schema("key string, value string").parquet(f"{folder}/log")
    return log.select(F.get_json_object("value", "$.id").alias("id"), F.col("key").alias("url"))


def crawl_articles(spark: SparkSession, d: str) -> DataFrame:
    """Listing pages, links, article pages, records: two groups, one pass."""
    return _crawl(spark, d).select("metadata", "id", "url", "components")


def crawl_limited(spark: SparkSession, d: str) -> DataFrame:
    """The same with at most 100 links per group and a seen table."""
    out = _crawl(spark, d, limit=100, seen=written(_seen_hosts(spark, d)))
    return out.select("metadata", "id", "url", "components")


def crawl_unique(spark: SparkSession, d: str) -> DataFrame:
    return unique_ids(written(_crawl(spark, d))).select("id", "url")


# ---------------------------------------------------------------- registry

HREF = {"extract": {"type": "attribute", "key": "href"}}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "article_components": article_components,
    "page_title": _one("title", {"selector": "title"}),
    "page_h1": _one("h1", {"selector": "h1"}),
    "meta_charset": _one(
        "charset", {"selector": "meta", "extract": {"type": "attribute", "key": "charset"}}
    ),
    "page_links": page_link_rows,
    "element_counts": element_counts,
    "element_shape": element_shape,
    "article_paragraph_count": article_paragraph_count,
    "nav_links_nested": _json(
        "nav",
        {
            "key": "nav",
            "selector": "nav li",
            "select": "all",
            "child": {"key": "a", "selector": "a", **HREF},
        },
    ),
    "nav_both_nested": _json(
        "nav",
        {
            "key": "nav",
            "selector": "nav li",
            "select": "all",
            "children": [
                {"key": "to", "selector": "a", **HREF},
                {"key": "text", "selector": "a"},
            ],
        },
    ),
    "head_first_children": _json(
        "head",
        {
            "key": "head",
            "selector": "article",
            "children": [
                {"key": "title", "selector": "title"},
                {"key": "h1", "selector": "h1"},
                {"key": "none", "selector": "h6"},
            ],
        },
    ),
    "include_self_order": _json(
        "parts",
        {
            "key": "parts",
            "selector": "title, nav li a, h1",
            "select": "all",
            "children": [
                {"key": "h", "selector": "h1, title", "include_self": True},
                {"key": "a", "selector": "div > a", "include_self": True},
            ],
        },
    ),
    "nth_nav_item": _one("item", {"selector": "li:nth-of-type(2) a"}),
    "last_nav_item": _one("item", {"selector": "nav li:last-child > a"}),
    "later_nav_items": _joined("items", {"selector": "li + li a"}),
    "css_class_text": _one("ad", {"selector": "div.ad"}),
    "css_attribute_prefix": _joined("hrefs", {"selector": "a[href^='/t']", **HREF}),
    "css_attribute_contains": _joined("hrefs", {"selector": "nav [href*='en']", **HREF}),
    "css_sibling": _one("h1", {"selector": "nav ~ article > h1"}),
    "css_has": _joined("texts", {"selector": "li:has(a[href='/de']) > a"}),
    "css_not": _joined("texts", {"selector": "nav li:not(:first-child):not(:last-child) a"}),
    "h1_html": _one("html", {"selector": "h1", "extract": {"type": "html"}}),
    "nav_html": _one("html", {"selector": "nav", "extract": {"type": "html"}}),
    "ad_classes": _joined(
        "words", {"selector": "div", "select": "first", "extract": {"type": "attribute", "key": "class"}}
    ),
    "script_text": _one("script", {"selector": "script"}),
    "link_pattern": _joined(
        "hrefs",
        {
            "selector": "a",
            **HREF,
            "modifiers": [{"type": "regex", "regex": ["^/[a-z]{2}$", "on"], "return": "original"}],
        },
    ),
    "abs_links": abs_links,
    "url_parts": url_parts,
    "valid_urls": valid_urls,
    "joined_links": joined_links,
    "links_distinct": links_distinct,
    "links_capped": links_capped,
    "links_unseen": links_unseen,
    "seen_upsert": seen_upsert,
    "seen_prune": seen_prune,
    "ttl_admitted": ttl_admitted,
    "ttl_admitted_large_keys": ttl_admitted_large_keys,
    "ttl_latest_seen": ttl_latest_seen,
    "regex_original": regex_original,
    "regex_first": regex_first,
    "epoch_dates": epoch_dates,
    "text_dates": text_dates,
    "json_scalar": json_scalar,
    "json_recursive": json_recursive,
    "strip_unicode": strip_unicode,
    "utf8_pages": utf8_pages,
    "spec_quality": spec_quality,
    "article_ids": article_ids,
    "article_log": article_log,
    "file_key_last_wins": file_key_last_wins,
    "insert_if_absent": insert_if_absent,
    "done_message": done,
    "per_domain_counts": per_domain_counts,
    "total_count": total_count,
    "stream_headlines": stream_headlines,
    "crawl_articles": crawl_articles,
    "crawl_limited": crawl_limited,
    "crawl_unique": crawl_unique,
    "crawl_repeated_pages": crawl_repeated_pages,
    "crawl_two_specs": crawl_two_specs,
    "stream_crawl": stream_crawl,
    "json_repeated_keys": json_repeated_keys,
    "json_bad_text": json_bad_text,
    "regex_braces": regex_braces,
    "ttl_small": ttl_small,
    "seed_listing": seed_listing,
    "nav_first_child": _json("nav", {"key": "nav", "selector": "nav", "child": {"key": "a", "selector": "a"}}),
    "any_element": _joined("charset", {"extract": {"type": "attribute", "key": "charset"}}),
    "by_id": _changed(
        "h1", lambda: F.replace("html", F.lit("<article>"), F.lit('<article id="main">')), {"selector": "#main h1"}
    ),
    "no_root": _changed(
        "h1",
        lambda: F.when(F.col("page_id") % 2 == 1, F.regexp_replace("html", "</?html[^>]*>", "")).otherwise(F.col("html")),
        {"selector": "h1"},
    ),
    "keyed_two_runs": keyed_two_runs,
    "seen_two_runs": seen_two_runs,
    "seen_generations": seen_generations,
    "done_after_failures": done_after_failures,
}


def entry(spark: SparkSession) -> DataFrame:
    return article_components(spark, "/root/testdata/sf0.001")


def _llm() -> tuple[dict, dict]:
    """The queries of the ``llm`` subpackage and of its pipeline, and their SQL; none if they are not installed."""
    parts = {"pagequarry.llm", "pagequarry.llm.queries", "corpus_pipeline"}
    try:
        import corpus_pipeline
        from pagequarry.llm import queries as llm
    except ModuleNotFoundError as e:
        if e.name not in parts:
            raise
        return {}, {}
    sql = dict(llm.ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**llm.QUERIES, "pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_llm()[0]}


def oracle_sql() -> dict[str, str]:
    from oracle_queries import ORACLE

    return {**{k: v for k, v in ORACLE.items() if k in _QUERIES}, **_llm()[1]}
