"""Which URLs were visited already, and until when that counts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import scan
from ..functions.time import MAX_MOMENT, moment
from ..sources.lineage import checkpointed, written

DEFAULT_TTL = timedelta(weeks=1)

#: Rows of a large key's visits that one task sorts or joins.
TASK_ROWS = 250_000


def unseen(
    links: DataFrame,
    seen: DataFrame | None,
    as_of: Column | datetime | None = None,
    url: str = "abs_url",
) -> DataFrame:
    """Links without a live entry.  An entry that expires right now is not live."""
    if seen is None:
        return links
    live = seen.filter(F.col("expiration_date") > moment(as_of)).select(
        F.col("url").alias("__seen")
    )
    return links.join(live, links[url] == live["__seen"], "left_anti")


def expiry(stored: Column, ttl: timedelta) -> Column:
    """``stored + ttl``, or the last possible moment if that would overflow."""
    last = F.lit(MAX_MOMENT.isoformat(" ")).cast("timestamp_ntz")
    span = F.lit(ttl)
    return F.when(stored > last - span, last).otherwise(stored + span)


def mark_seen(
    seen: DataFrame | None,
    urls: DataFrame,
    ttl: timedelta = DEFAULT_TTL,
    as_of: Column | datetime | None = None,
    url: str = "url",
    stored: str | None = None,
) -> DataFrame:
    """The seen table after storing ``urls``: one row per URL, the latest store wins.

    ``stored`` names a column with the time of each store; without it all rows
    are stored at ``as_of``.  Partial aggregation before the shuffle keeps a URL
    with very many rows cheap.
    """
    at = F.col(stored).cast("timestamp_ntz") if stored else moment(as_of)
    none = F.lit(None).cast("timestamp_ntz")
    rows = urls.select(F.col(url).alias("url"), at.alias("at"), none.alias("old"))
    if seen is not None:
        rows = rows.unionByName(
            seen.select("url", none.alias("at"), F.col("expiration_date").alias("old"))
        )
    # two plain maxima, so the aggregate hashes
    latest = rows.groupBy("url").agg(F.max("at").alias("at"), F.max("old").alias("old"))
    return latest.select(
        "url", F.coalesce(expiry(F.col("at"), ttl), F.col("old")).alias("expiration_date")
    )


def prune(seen: DataFrame, as_of: Column | datetime | None = None) -> DataFrame:
    """Entries that are still live."""
    return seen.filter(F.col("expiration_date") > moment(as_of))


def ttl_admit(
    visits: DataFrame, key: str, ts: str, ttl: timedelta, fold_limit: int = 20_000
) -> DataFrame:
    """Which visits of a stream of visits would be let in.

    Per key in time order, a visit is admitted if no admitted visit is still
    live; a refused visit does not prolong anything.  Returns the distinct
    admitted ``(key, ts)``.

    Keys with up to ``fold_limit`` distinct times are folded as one array.
    Larger keys are never gathered.  Their visits meet in cells as long as the TTL:
    a cell's first visit is admitted if the cell before has no visit less than a
    TTL earlier, and nothing else is where the next cell does not follow as closely.
    Only in the runs of cells that remain, every visit learns its successor (the first
    visit after its TTL) from windows over cells of a second, and the chains from the
    first visits are found by pointer doubling, so the number of rounds is the
    logarithm of the longest run and all joins are on unique keys.  The number of tasks
    grows with the visits, so a task sorts about ``TASK_ROWS`` of them.
    """
    v = visits.select(F.col(key).alias("k"), _micros(visits, ts).alias("t")).distinct()
    width = int(ttl / timedelta(microseconds=1))
    if width <= 0:
        return _named(v, key, ts, visits)
    sizes = v.groupBy("k").agg(F.count("*").alias("n"))
    hot = checkpointed(sizes.filter(F.col("n") > fold_limit))
    out = _fold(v.join(hot, "k", "left_anti"), width)
    rows = hot.agg(F.sum("n")).first()[0]
    if rows is not None:
        out = out.unionByName(_chain(v.join(hot.select("k"), "k", "left_semi"), width, rows))
    return _named(out, key, ts, visits)


_EPOCH = "1970-01-01 00:00:00"


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970; of the wall clock, if the column has no zone."""
    if df.schema[ts].dataType.typeName() == "timestamp":
        return F.unix_micros(ts)
    span = F.col(ts) - F.lit(_EPOCH).cast("timestamp_ntz")
    unit = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000}
    parts = [F.extract(F.lit(u), span).cast("bigint") * F.lit(m) for u, m in unit.items()]
    seconds = (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("bigint")
    return parts[0] + parts[1] + parts[2] + seconds


def _named(df: DataFrame, key: str, ts: str, like: DataFrame) -> DataFrame:
    if like.schema[ts].dataType.typeName() == "timestamp":
        back = F.timestamp_micros("t")
    else:
        seconds = (F.col("t").cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        back = F.lit(_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return df.select(F.col("k").alias(key), back.alias(ts))


def _fold(v: DataFrame, width: int) -> DataFrame:
    def admit(last: Column, out: Column, t: Column, then) -> Column:
        live = F.coalesce(last + width > t, F.lit(False))
        return F.when(live, then(last, out)).otherwise(then(t, F.concat(out, F.array(t))))

    nothing = F.lit(None).cast("bigint")
    once = v.groupBy("k").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    admitted = scan(F.col("ts"), nothing, admit, "bigint", lambda last, out: out)
    return once.select("k", F.explode(admitted).alias("t"))


def _dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` by its key, in more partitions than the session's if these would get too many rows."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _cells(v: DataFrame, width: int, rows: int) -> DataFrame:
    """``(k, c, t, begins, followed)`` for each cell of a TTL: its first time, whether no visit of the
    cell before is less than a TTL earlier, and whether a visit of the next cell is less than a TTL later."""
    none = F.lit(None).cast("bigint")

    def seen_from(step: int) -> Column:
        as_ = {0: "t", 1: "before", -1: "after"}[step]
        times = [(F.col("t") if n == as_ else none).alias(n) for n in ("t", "before", "after")]
        return F.struct((F.col("c") + step).alias("c"), *times)

    near = v.select("k", _cell("t", width).alias("c"), "t")
    near = near.select("k", F.inline(F.array(seen_from(0), seen_from(1), seen_from(-1))))
    cells = _dealt(near, 3 * rows, "k", "c").groupBy("k", "c").agg(
        F.min("t").alias("t"), F.max("t").alias("last"), F.max("before").alias("before"), F.min("after").alias("after")
    )
    return cells.filter(F.col("t").isNotNull()).select(
        "k",
        "c",
        "t",
        F.coalesce(F.col("before") + width <= F.col("t"), F.lit(True)).alias("begins"),
        F.coalesce(F.col("last") + width > F.col("after"), F.lit(False)).alias("followed"),
    )


def _cell(time: str, width: int) -> Column:
    """Rounded down, also below zero."""
    return F.expr(f"({time} - pmod({time}, {width}L)) div {width}L")


def _chain(v: DataFrame, width: int, rows: int) -> DataFrame:
    cells = written(_cells(v, width, rows))
    reached = cells.filter("begins").select("k", "t")
    runs = cells.filter(F.col("followed") | ~F.col("begins")).select("k", "c")
    if runs.isEmpty():
        return reached
    left = v.withColumn("c", _cell("t", width))
    left = _dealt(left, rows, "k", "c").join(runs, ["k", "c"], "left_semi").drop("c")
    # what is two TTLs later begins a run, or is in another one
    near = F.col("nxt") - width < F.col("t") + width
    jump = checkpointed(_successors(checkpointed(left), width, rows).filter(near))
    while not jump.isEmpty():
        further = _dealt(reached, rows, "k", "t").join(_dealt(jump, rows, "k", "t"), ["k", "t"])
        further = further.select("k", F.col("nxt").alias("t"))
        reached = checkpointed(_dealt(reached.unionByName(further), rows, "k", "t").distinct())
        second = jump.select("k", F.col("t").alias("nxt"), F.col("nxt").alias("nxt2"))
        twice = _dealt(jump, rows, "k", "nxt").join(_dealt(second, rows, "k", "nxt"), ["k", "nxt"])
        jump = checkpointed(twice.select("k", "t", F.col("nxt2").alias("nxt")))
    return reached


def _successors(v: DataFrame, width: int, rows: int) -> DataFrame:
    """``(k, t, nxt)``: for each time the first time of the key at least ``width`` later.

    Times and the moments asked for meet in cells of at most a second, the cells
    in groups of 4096, these in groups of 4096 again, and so on up to one group.
    Times are distinct microseconds, so a cell holds at most a million of them: no
    window grows with the visits of a key.
    """
    step = max(min(width // 64, 1_000_000), 1)
    first, last = v.agg(F.min("t"), F.max("t")).first()
    levels = 1
    while first is not None and (last + width) // (step * 4096**levels) - first // (step * 4096**levels) > 4096:
        levels += 1
    none = F.lit(None).cast("bigint")
    data = v.select("k", F.col("t").alias("x"), F.col("t").alias("d"), none.alias("t"))
    asked = v.select("k", (F.col("t") + width).alias("x"), none.alias("d"), "t")
    both = data.unionByName(asked)
    for i in range(levels + 1):
        width_i = F.lit(step * 4096**i).cast("bigint")
        # rounded down, also below zero
        both = both.withColumn(f"c{i}", ((F.col("x") - F.pmod(F.col("x"), width_i)) / width_i).cast("bigint"))
    both = _dealt(both, 2 * rows, "k", "c0")

    def first_later(by: list[str], order: str) -> Column:
        rows = W.partitionBy(*by).orderBy(F.col(order).desc())
        earlier_rows = rows.rowsBetween(W.unboundedPreceding, -1)
        return F.last("d", ignorenulls=True).over(earlier_rows)

    # per cell of each level, from the top: the first data point after it
    names = [f"c{i}" for i in range(levels + 1)]
    at_level = [both.groupBy("k", *names).agg(F.min("d").alias("d"))]
    for i in range(levels):
        at_level.append(at_level[-1].groupBy("k", *names[i + 1 :]).agg(F.min("d").alias("d")))
    beyond = at_level[-1].select("k", names[-1], first_later(["k"], names[-1]).alias("beyond"))
    for i in range(levels - 1, -1, -1):
        own = at_level[i].select("k", names[i], names[i + 1], first_later(["k", names[i + 1]], names[i]).alias("inside"))
        beyond = own.join(beyond, ["k", names[i + 1]]).select("k", names[i], F.coalesce("inside", "beyond").alias("beyond"))
    # first data point at or after the asked moment, inside the cell
    inside = (
        W.partitionBy("k", "c0")
        .orderBy(F.col("x").desc(), F.col("d").desc_nulls_last())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    answered = both.withColumn("near", F.last("d", ignorenulls=True).over(inside)).filter(
        F.col("t").isNotNull()
    )
    return (
        answered.join(beyond, ["k", "c0"])
        .select("k", "t", F.coalesce("near", "beyond").alias("nxt"))
        .filter(F.col("nxt").isNotNull())
    )
