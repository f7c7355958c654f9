"""Where articles go: files, a keyed table, a log, or nowhere.

Every sink writes the rows of one run below ``run=<run_id>`` and replaces that
folder if the run is repeated under its id, so a retry after a lost executor or a
restarted stream does not duplicate anything.  Without an id a run gets a new one,
so that nothing an earlier run stored is ever replaced.  A sink returns the ids it
has stored.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.urls import file_key
from ..operators.articles import article_json, done_message, pick
from .lineage import written

log = logging.getLogger(__name__)

#: ``(articles, run_id=..., **options)`` to the ids stored; None stands for all.
Sink = Callable[..., "DataFrame | None"]
SINKS: dict[str, Sink] = {}


def register_sink(name: str) -> Callable[[Sink], Sink]:
    """Make a function ``(articles, run_id=..., **options)`` available under a name."""

    def add(fn: Sink) -> Sink:
        SINKS[name] = fn
        return fn

    return add


def new_run_id() -> str:
    """Later ids sort after earlier ones."""
    return f"{datetime.now():%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def last_per_file(df: DataFrame) -> DataFrame:
    """One row per file key: the last one in discovery order."""
    return pick(df.select(file_key(F.col("url")).alias("file_key"), "*"), "file_key", F.max)


def absent(df: DataFrame, target: DataFrame | None, key: str = "id") -> DataFrame:
    """The first row per key, if the target does not have the key yet."""
    first = pick(df, key, F.min)
    if target is None:
        return first
    return first.join(target.select(key), key, "left_anti").select(*df.columns)


def log_entries(df: DataFrame) -> DataFrame:
    """``key`` and ``value`` of an append-only log; also the shape Kafka takes."""
    return df.filter(F.col("components").isNotNull()).select(
        F.col("url").alias("key"), article_json(df).alias("value")
    )


def _existing(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """The ids that other runs have stored; the run is text, whatever it looks like."""
    try:
        df = spark.read.schema("id string, run string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return df.filter(F.col("run") != run_id)


@register_sink("file")
def write_files(df: DataFrame, path: str, run_id: str | None = None) -> DataFrame:
    """One JSON document per article; ``read_files`` resolves overwrites.

    Rows are laid out by range of the file key, which starts with the host: a
    host stays together, a very large one is spread over several files, and
    the number of files does not depend on the number of hosts.
    """
    last = last_per_file(df)
    out = last.select(
        "file_key", article_json(df).alias("article"), "scrape_time", F.current_timestamp().alias("stored")
    )
    out = out.repartitionByRange("file_key").sortWithinPartitions("file_key")
    out.write.mode("overwrite").json(f"{path}/run={run_id or new_run_id()}")
    return df.select("id")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file_key, article)``: what each file holds after all runs.

    The latest article of a file counts; of equal times the one stored last, and of
    those the one of the greatest run id, which is the later run unless ids were given.
    """
    rows = spark.read.schema(
        "file_key string, article string, scrape_time timestamp, stored timestamp, run string"
    ).json(path)
    # microseconds have 19 digits at most, so the two make one number, whose maximum hashes
    scraped, stored = (F.coalesce(F.unix_micros(c), F.lit(0)).cast("decimal(19,0)") for c in ("scrape_time", "stored"))
    rows = rows.withColumn("_at", (scraped * F.expr("cast(10000000000000000000 as decimal(20,0))")).cast("decimal(38,0)") + stored)
    last = rows.groupBy("file_key").agg(F.max("_at").alias("_at"))
    tied = rows.join(last, ["file_key", "_at"])
    # a run stores a file once, so the run decides
    run = tied.groupBy("file_key").agg(F.max("run").alias("run"))
    return tied.join(run, ["file_key", "run"]).select("file_key", "article")


@register_sink("keyed")
def insert_if_absent(df: DataFrame, path: str, run_id: str | None = None) -> DataFrame:
    """Insert articles whose id is new; the first one stays."""
    run_id = run_id or new_run_id()
    target = _existing(df.sparkSession, path, run_id)
    new = absent(df, target).withColumn("_id", F.col("id"))
    new.write.mode("overwrite").parquet(f"{path}/run={run_id}")
    return df.sparkSession.read.schema("id string").parquet(f"{path}/run={run_id}")


@register_sink("log")
def append_log(df: DataFrame, path: str, run_id: str | None = None) -> DataFrame:
    """Append every article; duplicates are allowed."""
    log_entries(df).write.mode("overwrite").parquet(f"{path}/run={run_id or new_run_id()}")
    return df.filter(F.col("components").isNotNull()).select("id")


@register_sink("noop")
def noop(df: DataFrame, run_id: str | None = None) -> DataFrame:
    df.write.mode("append").format("noop").save()
    return df.select("id")


@dataclass
class Stored:
    """What became of the articles: the error of each sink or None, and the ids that at least one has stored."""

    outcome: dict[str, Exception | None]
    ids: DataFrame


def fan_out(
    df: DataFrame, sinks: list[tuple[str, dict]], run_id: str | None = None, stored: bool = False
) -> Stored:
    """Write to every sink; one that fails does not stop the others.

    The articles are computed once: unless they are ``stored`` already, they are
    written to the shared folder first, so losing an executor half-way does not
    mean parsing everything again.
    """
    run_id = run_id or new_run_id()
    if len(sinks) > 1 and not stored:
        df = written(df)
    outcome: dict[str, Exception | None] = {}
    ids = df.select("id").limit(0)
    for i, (name, options) in enumerate(sinks):
        label = name if name not in outcome else f"{name}#{i}"
        try:
            own = SINKS[name](df, run_id=run_id, **options)
            ids = ids.unionByName(df.select("id") if own is None else own.select("id"))
            outcome[label] = None
        except Exception as e:  # noqa: BLE001 - isolation is the point
            log.exception("sink %s failed", label)
            outcome[label] = e
    return Stored(outcome, ids.distinct())


def write_done(ids: DataFrame, path: str, run_id: str | None = None) -> None:
    """The completion notice of one run; no file if nothing was stored."""
    messages = done_message(ids)
    if not messages.isEmpty():
        messages.write.mode("overwrite").json(f"{path}/run={run_id or new_run_id()}")


# name -> function (ids, run_id=..., **options)
NOTIFIERS: dict[str, Sink] = {"noop": lambda ids, run_id=None: None, "file": write_done}
