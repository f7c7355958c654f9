"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.sources.lineage import new_folder, remove_folder, written


def connected(edges: DataFrame) -> DataFrame:
    """``node, comp`` for each node of ``a, b``: the smallest node that can be reached.

    Alternates large and small stars: every step hangs neighbours on the smallest
    node of a neighbourhood.  Neighbourhoods are never gathered; their minimum is
    aggregated and joined back.  A table per step, so a lost executor repeats one.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    if edges.isEmpty():
        return edges.limit(0).toDF("node", "comp")
    at, last = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        folder = new_folder(spark, "star")
        large = written(large, folder)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_at = new_folder(spark, "star")
        edges = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), small_at)
        remove_folder(spark, folder)
        if at:
            remove_folder(spark, at)
        at = small_at
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(pmod(xxhash64(b, a), 1000003))")).first()
        if state == last:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
        last = state
