"""Reading pages and the seen table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page_id bigint, url string, html string"
SEEN = "url string, expiration_date timestamp_ntz"


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on an input too small to be split.

    Parsing costs far more than reading.  A scan that would keep at least half
    of the cores idle is redistributed.  A large scan has many partitions per
    core and is left alone, so nothing is shuffled there.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan


def dealt(scan: DataFrame, *by: str, rows: int = 50_000) -> DataFrame:
    """Tasks of about ``rows`` rows each, however large the input, for work that costs far more than moving a row.

    A scan has as many tasks as its files allow, so on the same cores its longest task grows with
    the input.  Counting a Parquet scan reads footers only.
    """
    n = -(-scan.count() // rows)
    return scan.repartition(n, *by) if n > scan.rdd.getNumPartitions() else spread(scan)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages as Parquet: ``url``, ``html`` and whatever else there is."""
    return spread(spark.read.parquet(path))


def save_bucketed(pages: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Keep fetched pages as a table bucketed by URL.

    Joining links to it moves the links only; the HTML, nearly all of the data,
    is read where it lies.  Choose buckets so that one fits a task comfortably.
    """
    writer = pages.write.mode("overwrite").bucketBy(buckets, "url").sortBy("url")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw page files as ``(url, body)``; the file's path stands for the URL."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), F.col("content").alias("body"))


def decode_pages(raw: DataFrame, body: str = "body") -> DataFrame:
    """Bytes to text.  A page that is not valid UTF-8 is dropped, never repaired."""
    rest = [c for c in raw.columns if c != body]
    return raw.filter(F.is_valid_utf8(F.col(body).cast("string"))).select(
        *rest, F.col(body).cast("string").alias("html")
    )


def _required(name: str) -> Column:
    missing = F.raise_error(F.lit(f"seen table: key '{name}' is missing"))
    return F.when(F.col(name).isNull(), missing.cast("string")).otherwise(F.col(name))


def read_seen_lines(spark: SparkSession, path: str) -> DataFrame:
    """The seen table as JSON lines ``{"url", "expiration_date"}``; of equal URLs the last line wins.

    Broken JSON or a missing key fails the query.
    """
    lines = (
        spark.read.schema("url string, expiration_date string")
        .option("mode", "FAILFAST")
        .json(path)
        .select(
            _required("url").alias("url"),
            _required("expiration_date").cast("timestamp_ntz").alias("expiration_date"),
            F.struct(
                F.col("_metadata.file_path"),
                F.col("_metadata.file_block_start"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("pos"),
        )
    )
    last = F.max(F.struct("pos", "expiration_date")).alias("last")
    return lines.groupBy("url").agg(last).select("url", "last.expiration_date")


def write_seen_lines(seen: DataFrame, path: str) -> None:
    """Write the seen table as JSON lines."""
    stamp = F.date_format("expiration_date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    seen.select("url", stamp.alias("expiration_date")).write.mode("overwrite").json(path)
