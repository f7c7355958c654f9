"""Every registered query against its SQL, on the smallest data."""

import pytest

from __spark_entry__ import _QUERIES, entry, oracle_sql
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(_QUERIES) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["id", "url", "components"]
    assert df.count() == 50


@pytest.mark.parametrize("name", list(_QUERIES))
def test_query(spark, con, sf, name):
    assert compare(spark, con, _QUERIES[name], oracle_sql()[name], sf) is None


def test_json_tasks_are_bounded(spark, tmp_path):
    """One file of many rows is dealt out to tasks of bounded size; all rows stay."""
    from pyspark.sql import functions as F

    from pagequarry.sources.pages import dealt

    spark.range(1000).withColumn("t", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/rows")
    got = dealt(spark.read.parquet(f"{tmp_path}/rows"), "id", rows=40)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert got.rdd.getNumPartitions() == 25 and sum(sizes) == 1000 and max(sizes) < 100
    assert dealt(spark.read.parquet(f"{tmp_path}/rows"), "id").count() == 1000
