"""URL expressions against urllib on random and hand-written input."""

import random
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from pagequarry.functions.urls import (
    BLOCKED_HOSTS,
    absolute_url,
    file_key,
    is_malformed,
    is_valid_url,
    netloc,
    path,
    scheme,
)

BASE = "http://h.com/a/b?x=1"
PIECES = ["http:", "https:", "HTTP:", "mailto:", "//", "/", "a", "b.html", "..", ".", "?q=1", "#f",
          ";p=1", " ", "h.com", "user@h.com:8080", "é", "%20", ":", "x;y", "javascript:f()"]


def random_urls(n):
    rnd = random.Random(3)
    out = []
    while len(out) < n:
        u = "".join(rnd.choices(PIECES, k=rnd.randint(0, 8)))
        try:
            urlparse(u).netloc, urljoin(BASE, urlparse(u).path)
        except ValueError:
            continue
        out.append(u)
    return out


def expected_absolute(href, base):
    p = urlparse(href)
    if p.scheme not in ("http", "https") and p.path:
        return urljoin(base, p.path)
    return href


def expected_valid(url):
    p = urlparse(url)
    host = p.netloc.lower()
    return p.scheme in ("http", "https") and bool(host) and not any(b in host for b in BLOCKED_HOSTS)


def test_against_urllib(spark):
    urls = random_urls(1500)
    bases = [BASE, "https://h.com", "http://h.com/x/y/;p/z", "http://h.com/a//b/../c"]
    rows = [(i, u, bases[i % len(bases)]) for i, u in enumerate(urls)]
    got = (
        spark.createDataFrame(rows, "i int, u string, b string")
        .select(
            "u",
            "b",
            scheme(F.col("u")).alias("scheme"),
            netloc(F.col("u")).alias("netloc"),
            path(F.col("u")).alias("path"),
            absolute_url(F.col("u"), F.col("b")).alias("abs"),
            is_valid_url(F.col("u")).alias("valid"),
        )
        .collect()
    )
    for r in got:
        p = urlparse(r.u)
        assert (r.scheme, r.netloc, r.path) == (p.scheme, p.netloc, p.path), r.u
        assert r.abs == expected_absolute(r.u, r.b), (r.u, r.b)
        assert r.valid == expected_valid(r.u), r.u


def test_links_by_hand(spark):
    want = {
        "/p?q=1#f": "http://h.com/p",
        "c": "http://h.com/a/c",
        "../d": "http://h.com/d",
        "//o.com/p": "http://h.com/p",
        "mailto:x@y": "http://h.com/a/x@y",
        "?q=1": "?q=1",
        "#f": "#f",
        "https://o.com/p?q=1": "https://o.com/p?q=1",
    }
    df = spark.createDataFrame([(k,) for k in want], "u string")
    got = {r.u: r.a for r in df.select("u", absolute_url(F.col("u"), F.lit(BASE)).alias("a")).collect()}
    assert got == want


def test_validity_by_hand(spark):
    want = {
        "h.com/p": False,
        "ftp://h/p": False,
        "http:///p": False,
        "HTTP://h.com": True,
        "http://localhost/x": False,
        "http://h.com:8080/": False,
        "http://news10.com/": False,
        "http://[::1]/": False,
        "http://[h.com/": False,
        "http://h.com/0": True,
    }
    df = spark.createDataFrame([(k,) for k in want], "u string")
    got = {r.u: r.v for r in df.select("u", is_valid_url(F.col("u")).alias("v")).collect()}
    assert got == want
    loose = df.select("u", is_valid_url(F.col("u"), strict=False).alias("v")).collect()
    assert {r.u for r in loose if r.v} >= {"http://news10.com/", "http://h.com:8080/"}
    assert not [r.u for r in loose if r.v and "localhost" in r.u]


def test_malformed_and_file_key(spark):
    df = spark.createDataFrame([("http://[h/",), ("http://h.com/a/b?x=1",)], "u string")
    rows = df.select(is_malformed(F.col("u")).alias("m"), file_key(F.col("u")).alias("k")).collect()
    assert [r.m for r in rows] == [True, False]
    assert rows[1].k == "h.com_a_b.json"
