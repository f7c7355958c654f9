"""From links and pages to article records."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import fixed_map, with_once
from ..functions.time import instant
from ..functions.urls import netloc
from ..plans.spec import Spec
from .extract import components_json, shred_for
from ..sources.lineage import written
from .fetch import latest_copy
from .links import packed, per_tree


def fetch_join(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``(abs_url, html, wanted_by)``: the page of each link; links without a page drop out.

    Links are gathered per URL first (at most one per group of the spec), so a
    page moves, and is later parsed, once.  Which copy of a page counts, and how
    it is found, says ``latest_copy``.  For pages saved with ``save_bucketed``
    only the links are shuffled.
    """
    place = F.struct("group_id", "seed_pos", "link_pos")
    wanted = links.groupBy("abs_url").agg(F.collect_list(place).alias("wanted_by"))
    return latest_copy(written(wanted), "abs_url", pages)


def article_id(url: Column, components_json: Column) -> Column:
    """Content hash: same domain and same content give the same id."""
    return F.sha1(F.concat(netloc(url), F.lit("-"), components_json))


def extract_groups(fetched: DataFrame, spec: Spec, as_of: datetime | None = None) -> DataFrame:
    """Evaluate each page with the selectors of the groups that want it, in one pass.

    ``components`` is JSON text, so that all groups share a schema.  Rows
    without a result are dropped.
    """
    parsed = shred_for(fetched, *(g.selectors for g in spec.groups))
    trees, value = per_tree(spec.groups, "selectors", lambda s: components_json("dom", s, as_of))
    once = with_once(parsed, "trees", trees)
    rows = once.select("abs_url", "trees", F.inline("wanted_by"))
    return rows.select(
        "group_id", "seed_pos", "link_pos", "abs_url", value.alias("components")
    ).filter(F.col("components").isNotNull())


def articles(
    extracted: DataFrame, spec: Spec, as_of: Column | datetime | None = None
) -> DataFrame:
    """``metadata, id, url, scrape_time, components``, plus discovery order."""
    known = {str(i): json.dumps(g.metadata) for i, g in enumerate(spec.groups) if g.metadata is not None}
    metadata = F.try_element_at(
        fixed_map(known, "map<string,string>"), F.col("group_id").cast("string")
    )
    return extracted.select(
        metadata.alias("metadata"),
        article_id(F.col("abs_url"), F.col("components")).alias("id"),
        F.col("abs_url").alias("url"),
        instant(as_of).alias("scrape_time"),
        "components",
        F.struct("group_id", "seed_pos", "link_pos").alias("found_at"),
    )


def article_json(df: DataFrame) -> Column:
    """The whole record as one JSON document; ``metadata`` only if present."""
    raw = {"metadata": "metadata", "components": "components"}
    parts = []
    for name in ("metadata", "id", "url", "scrape_time", "components"):
        if name in raw:
            text = F.concat(F.lit(f'"{name}":'), F.col(name))
        elif name == "scrape_time":
            stamp = F.date_format("scrape_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            text = F.concat(F.lit(f'"{name}":"'), stamp, F.lit('"'))
        else:
            quoted = F.to_json(F.array(name))
            text = F.concat(F.lit(f'"{name}":'), F.substr(quoted, F.lit(2), F.length(quoted) - 2))
        parts.append(text)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def discovery_order(df: DataFrame) -> Column:
    """The place where an article was found, as a number if it can be one, so that minima and maxima hash."""
    if "found_at" not in df.columns:
        return F.col("url")
    fields = {f.name for f in df.schema["found_at"].dataType.fields}
    if fields == {"group_id", "seed_pos", "link_pos"}:
        return packed("found_at.seed_pos", "found_at.link_pos", "found_at.group_id")
    return F.col(f"found_at.{fields.pop()}") if len(fields) == 1 else F.col("found_at")


def pick(df: DataFrame, key: str, best) -> DataFrame:
    """The row of each ``key`` whose place in discovery order is ``best`` (``F.min`` or ``F.max``).

    Only keys and places are aggregated, and reduced before the shuffle; the
    records, which are large, meet the winners in a join.  Rows of one place are
    copies of each other and count once.
    """
    placed = df.withColumn("_place", discovery_order(df))
    won = placed.groupBy(key).agg(best("_place").alias("_place"))
    rows = placed.join(won, [key, "_place"])
    if "found_at" not in df.columns:
        rows = rows.dropDuplicates([key])
    return rows.select(*df.columns)


def unique_ids(df: DataFrame) -> DataFrame:
    """One article per id, the first one found."""
    return pick(df, "id", F.min)


def done_message(df: DataFrame) -> DataFrame:
    """The completion notice ``part, done``: a message for each part that has ids, a JSON array of ``{"id"}``.

    The part is the first two digits of the MD5 of an id, at any size: at most 256
    messages, none of them with all ids.
    """
    ids = df.select("id").distinct()
    listed = F.to_json(F.sort_array(F.collect_list(F.struct("id"))))
    part = F.substring(F.md5(F.col("id").cast("binary")), 1, 2)
    return ids.groupBy(part.alias("part")).agg(listed.alias("done"))


def domain_counts(df: DataFrame) -> DataFrame:
    """Distinct articles per domain."""
    return (
        df.select(netloc(F.col("url")).alias("domain"), "id")
        .distinct()
        .groupBy("domain")
        .agg(F.count("*").alias("n_articles"))
    )


def article_count(df: DataFrame) -> DataFrame:
    """One row: the number of distinct articles."""
    return df.select("id").distinct().agg(F.count("*").alias("n_articles"))
