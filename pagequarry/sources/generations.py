"""A seen store whose reading stays cheap, however many runs have added to it.

Every run adds a folder of its own entries, one per URL.  Whenever enough runs of
one generation have gathered, they are merged into one of the next, which keeps
the latest entry per URL; so the number of folders to read grows with the
logarithm of the number of runs.  What has expired is dropped by merges that no
older entries lie below: elsewhere an expired entry still hides an earlier one.  What counts is listed in a
manifest.  A manifest is a new file, ``manifest/<version>``, moved into place
whole: a reader sees the folders before a merge or after it, and a merge that ends
half-way leaves nothing but folders that no manifest lists.

One writer at a time: runs that add at the same moment must take turns.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import moment
from .lineage import file_system
from .pages import SEEN

#: Folders of one generation that become one of the next.
RATIO = 8
#: Manifests and merged folders that stay for readers which have begun with them.
KEPT_VERSIONS = 2
ENTRIES = f"{SEEN}, stored timestamp_ntz"


@dataclass(frozen=True)
class Part:
    """A folder of entries: of one run, or of the runs that were merged into it."""

    folder: str
    generation: int
    runs: tuple[str, ...]


class SeenGenerations:
    """Entries below ``path`` as Parquet, in generations; a ``SeenStore``."""

    def __init__(self, path: str, ratio: int = RATIO):
        if ratio < 2:
            raise ValueError("ratio must be 2 or more")
        self.path, self.ratio = path.rstrip("/"), ratio

    # ------------------------------------------------------------ manifest

    def _versions(self, spark: SparkSession) -> list[int]:
        system, path = file_system(spark, f"{self.path}/manifest")
        if not system.exists(path):
            return []
        return sorted(int(f.getPath().getName()) for f in system.listStatus(path) if f.getPath().getName().isdigit())

    def parts(self, spark: SparkSession) -> list[Part]:
        """The folders that count now."""
        versions = self._versions(spark)
        if not versions:
            return []
        text = spark.read.text(f"{self.path}/manifest/{versions[-1]}", wholetext=True).first()[0]
        return [Part(p["folder"], p["generation"], tuple(p["runs"])) for p in json.loads(text)]

    def _switch(self, spark: SparkSession, parts: list[Part]) -> None:
        """Let these parts count: a new version, written aside and moved into place."""
        version = (self._versions(spark) or [0])[-1] + 1
        aside = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        system, path = file_system(spark, aside)
        stream = system.create(path, True)
        try:
            stream.write(bytearray(json.dumps([p.__dict__ for p in parts]).encode()))
        finally:
            stream.close()
        if not system.rename(path, file_system(spark, f"{self.path}/manifest/{version}")[1]):
            raise RuntimeError(f"{self.path}: version {version} of the manifest was written by someone else")

    def _tidy(self, spark: SparkSession) -> None:
        """Remove old manifests, and folders that no manifest lists any more."""
        versions = self._versions(spark)
        for old in versions[:-KEPT_VERSIONS]:
            system, path = file_system(spark, f"{self.path}/manifest/{old}")
            system.delete(path, False)
        listed: set[str] = set()
        for version in versions[-KEPT_VERSIONS:]:
            text = spark.read.text(f"{self.path}/manifest/{version}", wholetext=True).first()[0]
            listed |= {p["folder"] for p in json.loads(text)}
        system, path = file_system(spark, f"{self.path}/parts")
        for found in system.listStatus(path):
            if found.getPath().getName() not in listed:
                system.delete(found.getPath(), True)

    # ------------------------------------------------------------ entries

    def _rows(self, spark: SparkSession, parts: list[Part]) -> DataFrame:
        return spark.read.schema(ENTRIES).parquet(*[f"{self.path}/parts/{p.folder}" for p in parts])

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        """The entry of each URL that was stored last; of those stored at one moment, the one that lives longest."""
        at = rows.groupBy("url").agg(F.max("stored").alias("stored"))
        return rows.join(at, ["url", "stored"]).groupBy("url", "stored").agg(F.max("expiration_date").alias("expiration_date"))

    def read(self, spark: SparkSession, run_id: str | None = None) -> DataFrame | None:
        """The latest entry per URL of all runs but ``run_id``; with a ``*`` at its end, but those that begin so.

        A run that has been merged with others can no longer be told apart and is seen.
        """
        parts = self.parts(spark)
        if run_id is not None:
            own = (lambda r: r.startswith(run_id[:-1])) if run_id.endswith("*") else (lambda r: r == run_id)
            parts = [p for p in parts if not all(own(r) for r in p.runs)]
        if not parts:
            return None
        return self._latest(self._rows(spark, parts)).select("url", "expiration_date")

    def add(self, entries: DataFrame, run_id: str, stored: datetime | None = None) -> None:
        """Store the entries of a run, in place of those it had stored before, and merge what is due."""
        spark = entries.sparkSession
        rows = entries.select("url", "expiration_date", moment(stored).alias("stored"))
        folder = f"g0-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/parts/{folder}")
        parts = [p for p in self.parts(spark) if p.runs != (run_id,)]
        self._switch(spark, [*parts, Part(folder, 0, (run_id,))])
        self.merge_due(spark, stored)

    def merge_due(self, spark: SparkSession, as_of: datetime | None = None) -> None:
        """Merge each generation that has gathered enough folders; the last run stays apart, since it may be repeated."""
        generation = 0
        while True:
            parts = self.parts(spark)
            due = [p for p in parts if p.generation == generation]
            if generation == 0:
                due = due[:-1]
            if len(due) >= self.ratio:
                self._merge(spark, parts, due, generation + 1, as_of)
            elif not any(p.generation > generation for p in parts):
                break
            generation += 1
        self._tidy(spark)

    def _merge(self, spark: SparkSession, parts: list[Part], due: list[Part], generation: int, as_of: datetime | None) -> None:
        folder = f"g{generation}-{uuid.uuid4().hex}"
        rest = [p for p in parts if p not in due]
        latest = self._latest(self._rows(spark, due))
        if not any(p.generation >= generation for p in rest):
            latest = latest.where(F.col("expiration_date") > moment(as_of))
        latest.select("url", "expiration_date", "stored").write.parquet(f"{self.path}/parts/{folder}")
        runs = tuple(r for p in due for r in p.runs)
        at = parts.index(due[0])
        self._switch(spark, [*rest[:at], Part(folder, generation, runs), *rest[at:]])
