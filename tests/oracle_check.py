"""Run the registered queries and their SQL over the same tables and compare."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t)
    )


def compare(spark, con, query, sql, sf_dir):
    """None if equal, else a short description."""
    df = query(spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = _rows([c[0] for c in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}: {[r for r in got if r not in set(want)][:2]} / {[r for r in want if r not in set(got)][:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} vs {w}"[:600]
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = connect(sf), oracle_sql()
    for name, q in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            if name in sqls:
                out = compare(spark, con, q, sqls[name], sf) or "ok"
            else:
                out = f"rows only: {q(spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            out = "ERROR " + str(e)[:500]
        print(f"{name:28} {time.time() - t:6.2f}s  {out}", flush=True)
