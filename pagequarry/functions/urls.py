"""URL splitting, joining and checking as JVM expressions.

``parse_url`` raises on URLs that occur in real pages (a space in the path is
enough), so the pieces are cut with the pattern of RFC 3986, appendix B.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
# scheme, authority, path, parameters of the last segment, query, fragment
_PARTS = (
    r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://([^/?#]*))?"
    r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
# Schemes whose last path segment may carry ';parameters'.
_WITH_PARAMS = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "sip", "sips",
                "mms", "sftp", "tel"]
# Hosts that are refused, tested as substrings of the network location.
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "0", "::", "[::]", "[0000::1]"]


def _clean(url: Column) -> Column:
    """Browsers and Python drop these before looking at a URL."""
    return F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+", ""), "[\\t\\r\\n]", "")


def _path_without_params(path: Column, scheme: Column) -> Column:
    # the cut is at the first ';' of the last segment
    cut = F.regexp_extract(path, r"(?s)^((?:.*/)?[^/;]*)", 1)
    return F.when(scheme.isin(_WITH_PARAMS), cut).otherwise(path)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _SCHEME, 1))


def netloc(url: Column) -> Column:
    """User info, host and port, case kept; empty if there is none."""
    return F.regexp_extract(_clean(url), _PARTS, 1)


def path(url: Column) -> Column:
    """The path without the parameters of its last segment."""
    return let(
        _clean(url),
        lambda u: _path_without_params(
            F.regexp_extract(u, _PARTS, 2), F.lower(F.regexp_extract(u, _SCHEME, 1))
        ),
    )


def is_malformed(url: Column) -> Column:
    """URLs that cannot be split at all: unbalanced brackets in the authority."""
    host = netloc(url)
    return host.contains("[") != host.contains("]")


def split_url(url: Column) -> Column:
    """``struct<scheme, netloc, path>``."""
    return F.struct(
        scheme(url).alias("scheme"), netloc(url).alias("netloc"), path(url).alias("path")
    )


def _resolve_dots(segments: Column) -> Column:
    """Remove '.' and apply '..' from left to right."""

    def apply(done: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(seg == ".", done)
            .otherwise(F.concat(done, F.array(seg)))
        )

    return F.aggregate(segments, F.array().cast("array<string>"), apply)


def _join_path(base_path: Column, ref: Column) -> Column:
    base_dir = F.regexp_extract(base_path, r"(?s)^(.*/)?", 0)
    relative = F.split(F.concat(base_dir, ref), "/")
    # empty segments in the middle of a relative join are dropped
    inner = F.filter(relative, lambda s, i: (s != "") | (i == 0) | (i == F.size(relative) - 1))
    segments = F.when(ref.startswith("/"), F.split(ref, "/")).otherwise(inner)

    def finish(segs: Column) -> Column:
        last = F.element_at(segs, -1)
        done = F.concat(
            _resolve_dots(segs),
            F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(
                F.array().cast("array<string>")
            ),
        )
        joined = F.array_join(done, "/")
        return F.when(joined == "", F.lit("/")).otherwise(joined)

    return let(segments, finish)


def _join(base: Column, ref: Column) -> Column:
    """Join a path taken from a link to an http(s) base."""

    def run(p: Column) -> Column:
        base_scheme = p["b"]["scheme"]
        own_scheme, own_host = scheme(ref), netloc(ref)
        # the reference may itself look like a URL once its scheme is gone
        params = F.regexp_extract(ref, r"(?s)^(?:.*/)?[^/;]*(;[^/]*)$", 1)
        joined = _join_path(p["b"]["path"], p["path"])
        joined = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
        absolute = F.concat(base_scheme, F.lit("://"), p["b"]["netloc"], joined, params)
        with_host = F.concat(
            base_scheme, F.lit("://"), own_host,
            F.when(p["path"].startswith("/") | (p["path"] == ""), p["path"]).otherwise(
                F.concat(F.lit("/"), p["path"])
            ),
            params,
        )
        return (
            F.when((own_scheme != "") & (own_scheme != base_scheme), ref)
            .when(own_host != "", with_host)
            .when((p["path"] == "") & (params == ""), F.regexp_replace(_clean(base), "#.*$", ""))
            .otherwise(absolute)
        )

    return let(F.struct(split_url(base).alias("b"), path(ref).alias("path")), run)


def absolute_url(href: Column, base: Column) -> Column:
    """Make a link absolute.

    http(s) links and links without a path stay as they are; of every other
    link only the path is kept and joined to the base, so a relative link loses
    its query and fragment.
    """

    def run(u: Column) -> Column:
        keep = u["scheme"].isin("http", "https") | (u["path"] == "")
        return F.when(keep, href).otherwise(_join(base, u["path"]))

    return let(split_url(href), run)


def is_valid_url(url: Column, strict: bool = True) -> Column:
    """http(s) with a host that is not refused.

    ``strict`` tests the refused hosts as substrings of the network location,
    so any host or port with the digit 0 is refused; otherwise the host itself
    must be one of them.
    """

    def run(u: Column) -> Column:
        host = F.lower(u["netloc"])
        if strict:
            blocked = F.lit(False)
            for b in BLOCKED_HOSTS:
                blocked = blocked | host.contains(b)
        else:
            bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
            blocked = bare.isin(BLOCKED_HOSTS)
        return u["scheme"].isin("http", "https") & (u["netloc"] != "") & ~blocked

    return F.coalesce(let(split_url(url), run), F.lit(False)) & ~F.coalesce(
        is_malformed(url), F.lit(False)
    )


def file_key(url: Column) -> Column:
    """Name of the file an article is stored in; the query does not count."""
    return F.concat(netloc(url), F.replace(path(url), F.lit("/"), F.lit("_")), F.lit(".json"))
