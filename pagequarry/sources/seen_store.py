"""Where the seen table is kept between runs.

A store has ``read(spark, run_id)`` and ``add(entries, run_id)``.  Both kinds
of files only ever get the new entries of a run, in a folder of their own; the
latest entry per URL is resolved when reading.  A repeated run replaces its own
folder and does not see it, so retries give the same result.
"""

from __future__ import annotations

from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.time import moment
from ..operators.seen import prune
from .generations import SeenGenerations
from .pages import SEEN


class SeenStore(Protocol):
    def read(self, spark: SparkSession, run_id: str | None = None) -> DataFrame | None: ...

    def add(
        self, entries: DataFrame, run_id: str, stored: datetime | None = None
    ) -> None: ...


class NoSeen:
    """Remembers nothing, admits everything."""

    def read(self, spark: SparkSession, run_id: str | None = None) -> DataFrame | None:
        return None

    def add(self, entries: DataFrame, run_id: str, stored: datetime | None = None) -> None:
        return None


class SeenFiles:
    """Entries under ``path/run=<run_id>`` as Parquet or JSON lines."""

    def __init__(self, path: str, file_format: str = "parquet"):
        self.path, self.format = path, file_format

    def read(self, spark: SparkSession, run_id: str | None = None) -> DataFrame | None:
        """The latest entry per URL of all runs but ``run_id``; with a ``*`` at its end, but those that begin so."""
        schema = f"{SEEN}, stored timestamp_ntz, run string"
        reader = spark.read.schema(schema).format(self.format)
        if self.format == "json":
            reader = reader.option("mode", "FAILFAST")
        try:
            rows = reader.load(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        if run_id is not None:
            own = F.col("run").startswith(run_id[:-1]) if run_id.endswith("*") else F.col("run") == run_id
            rows = rows.filter(~own)
        latest = F.max_by("expiration_date", "stored").alias("expiration_date")
        return rows.groupBy("url").agg(latest)

    def add(self, entries: DataFrame, run_id: str, stored: datetime | None = None) -> None:
        rows = entries.select("url", "expiration_date", moment(stored).alias("stored"))
        rows.write.mode("overwrite").format(self.format).save(f"{self.path}/run={run_id}")

    def compact(
        self, spark: SparkSession, target: str, as_of: datetime | None = None
    ) -> "SeenFiles":
        """Live entries of all runs as a new store at ``target``."""
        fresh = SeenFiles(target, self.format)
        rows = self.read(spark)
        if rows is not None:
            fresh.add(prune(rows, as_of), "compacted", as_of)
        return fresh


SEEN_STORES = {
    "noop": NoSeen,
    "file": lambda path: SeenFiles(path, "json"),
    "table": lambda path: SeenFiles(path, "parquet"),
    "generations": SeenGenerations,
}
