"""What a file holds when several runs have written it."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagequarry.sources.sinks import read_files

NOW = datetime(2024, 1, 10, 12)


@pytest.mark.parametrize("order", [("a", "b", "c"), ("c", "b", "a"), ("10", "9", "7")])
def test_ties_go_to_the_greatest_run(spark, tmp_path, order):
    for run in order:
        rows = [("same", run, NOW, NOW), ("newer", run, NOW + timedelta(days=run == order[0]), NOW), ("stored", run, NOW, NOW + timedelta(hours=run == order[0]))]
        rows.append(("old", run, datetime(1960, 1, 1) - timedelta(days=run == order[0]), NOW))
        df = spark.createDataFrame(rows, "file_key string, article string, scrape_time timestamp, stored timestamp")
        df.write.json(f"{tmp_path}/run={run}")
    got = {r.file_key: r.article for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"same": max(order), "newer": order[0], "stored": order[0], "old": max(order[1:])}
    assert read_files(spark, str(tmp_path)).where(F.col("article").isNull()).count() == 0
