"""Pages that keep arriving, with Structured Streaming.

Extraction is a narrow projection, so ``extract`` works on a streaming
DataFrame as it is.  A whole run needs two tables that grow with the stream: the
pages that have arrived, and the links that were found.  A link finds its page
whichever of them comes first: new links are joined with all pages so far, older
links with the new pages.  So any split of the input gives what one batch gives.
Everything a batch writes is named after the batch, so replaying one after a
failure replaces its output.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions.time import moment
from ..operators.articles import articles, extract_groups, fetch_join
from ..operators.links import discover, distinct_links
from ..operators.seen import DEFAULT_TTL
from ..plans.runs import deliver, merged
from ..plans.spec import Spec
from ..sources.lineage import cleaning, written
from ..sources.pages import PAGES
from ..sources.seen_store import SeenStore

LINKS = "group_id int, seed_pos bigint, link_pos int, abs_url string"
FETCHED = "group_id int, abs_url string, at timestamp_ntz"


def stream_pages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New page files of a folder as a stream."""
    reader = spark.readStream.schema(PAGES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _earlier(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """What the batches before this one have left in a table."""
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows.where(F.col("batch") < batch).drop("batch")


def run_stream(
    spec: Spec | list[Spec],
    pages: DataFrame,
    seen_store: SeenStore,
    checkpoint: str,
    sinks: list[tuple[str, dict]],
    notify: tuple[str, dict] = ("noop", {}),
    limit: int | None = None,
    ttl: timedelta = DEFAULT_TTL,
    as_of: datetime | None = None,
    every: str | None = None,
    state: str | None = None,
    start: DataFrame | None = None,
) -> StreamingQuery:
    """Run the spec on everything that has arrived, then stop; or go on, ``every`` so often.

    ``state`` (next to the checkpoint, unless given) keeps pages, links and what
    was fetched; nothing is dropped from it.  URLs that other runs have stored as
    seen are left out; within the stream a group fetches a URL once per ``ttl``.
    ``limit`` counts the links found in a batch; ``start`` is as in ``discover``.
    """
    one = spec if isinstance(spec, Spec) else merged(spec)
    state = state or f"{checkpoint.rstrip('/')}-state"
    name = "stream-" + hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, as_of or datetime.now()

        def kept(df: DataFrame, table: str) -> DataFrame:
            return written(df, f"{state}/{table}/batch={batch_id}", replace=True)

        with cleaning(spark):
            arrived = kept(batch, "pages")
            before = {t: _earlier(spark, f"{state}/{t}", s, batch_id) for t, s in (("pages", PAGES), ("links", LINKS), ("fetched", FETCHED))}
            all_pages = before["pages"].unionByName(arrived.select("page_id", "url", "html"))
            others = seen_store.read(spark, f"{name}-*")
            key = ["group_id", "abs_url"]
            live = before["fetched"].where(F.col("at") + F.lit(ttl) > moment(now)).select(*key)
            found = discover(arrived, one, others, limit, now, start=start)
            found = found.join(live, key, "left_anti").select("group_id", "seed_pos", "link_pos", "abs_url")
            found = kept(found, "links")
            waiting = distinct_links(before["links"]).join(live, key, "left_anti").join(found, key, "left_anti")
            fetched = written(fetch_join(found, all_pages).unionByName(fetch_join(waiting, arrived)))
            kept(fetched.select(F.inline("wanted_by"), "abs_url").select(*key, moment(now).alias("at")), "fetched")
            out = written(articles(extract_groups(fetched, one, now), one, now))
            deliver(out, f"{name}-{batch_id}", sinks, notify, seen_store, ttl, now)

    writer = pages.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    when = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**when).start()
