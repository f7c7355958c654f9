"""Cutting lineage between the stages of a job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Without it, a folder in the session's warehouse, which all executors share too.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def file_system(spark: SparkSession, folder: str):
    """The file system of a folder, and its path there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def new_folder(spark: SparkSession, kind: str) -> str:
    """A place for a new table below the shared folder; it is removed when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    system, path = file_system(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    for made in _MADE:
        made.append(f"{folder}/rows")
    return f"{folder}/rows"


#: For each ``cleaning`` that is going on, the tables made since it began.
_MADE: list[list[str]] = []


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside when the block ends; nothing lazy may leave it."""
    _MADE.append([])
    try:
        yield
    finally:
        for table in _MADE.pop():
            remove_folder(spark, table)


def remove_folder(spark: SparkSession, table: str) -> None:
    """Remove what ``new_folder`` named, when nothing reads it any more."""
    system, path = file_system(spark, table.removesuffix("/rows"))
    system.delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside the block remove their shuffle files when they end; each must write or collect what it finds."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str | None = None, replace: bool = False) -> DataFrame:
    """The same as a table, whose size the planner then knows."""
    spark = df.sparkSession
    path = folder or new_folder(spark, "stage")
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
