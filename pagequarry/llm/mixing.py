"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source the keys are cut into
ranges; prefix sums of the token counts over the ranges find the range in which
the source's budget ends, and only that range is sorted to find the document.
What a document contributes then follows from its key and one row per source, so
that no text is moved and no source meets in one task.

Defined cases: a null or empty text has size 0 and contributes nothing; null
sources are one source, the last; rows that share a source and ``doc_id`` share a
key and at the cut each gets its part; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.words import SPACE_CHARS, SPACES
from pagequarry.sources.lineage import written

#: Digits of the key that name its range: 65,536 ranges in each source.
RANGE_DIGITS = 4


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, SPACES))).otherwise(0).cast("long")


def _key(doc_id: Column) -> Column:
    return F.coalesce(F.md5(doc_id.cast("string").cast("binary")), F.lit(""))


def _source(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """``source, source_size, target`` for each source of ``source, size``.

    Sources in order, null last, take the ``weights`` in turn and share ``share``
    of all sizes; what is above ``cap`` times a source's size is shared again
    among the others.  By size over weight ascending, the capped sources come
    first, which makes the fixed point a matter of prefix sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumns(
        {
            "total": F.lit(float(share)) * F.sum("source_size").over(every),
            "below": F.coalesce(F.sum("most").over(before), F.lit(0.0)),
            "open_w": F.sum("w").over(after),
        }
    ).withColumn("full", F.col("most") * F.col("open_w") <= (F.col("total") - F.col("below")) * F.col("w"))
    per = per.withColumns(
        {
            "full_most": F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0)),
            "free_w": F.sum(F.when(~F.col("full"), F.col("w"))).over(every),
        }
    )
    free = F.col("w") * (F.col("total") - F.col("full_most")) / F.col("free_w")
    return per.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(free).alias("target"))


def cuts(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """Where each source's budget ends: ``src, source_size, target, epochs, cut_key, cut_id, cut_words, cut_size``.

    ``sized``: ``doc_id, source, size``.  The last document is taken in part, so
    that the words taken are the whole part of the target.
    """
    goal = goal.withColumn("src", _source(F.col("source"))).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs.cast("long"))
    goal = goal.withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    keyed = sized.select(_source(F.col("source")).alias("src"), _key(F.col("doc_id")).alias("key"), "doc_id", "size")
    in_range = F.substring("key", 1, RANGE_DIGITS)
    ranges = keyed.groupBy("src", in_range.alias("part")).agg(F.sum("size").alias("part_size"))
    prefix = Window.partitionBy("src").orderBy("part")
    ranges = ranges.withColumn("upto", F.sum("part_size").over(prefix)).join(goal.select("src", "rest"), "src")
    last = ranges.where((F.col("upto") - F.col("part_size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
    last = last.select("src", "part", (F.col("rest") - F.col("upto") + F.col("part_size")).alias("left"))
    units = keyed.withColumn("part", in_range).join(last, ["src", "part"])
    units = units.groupBy("src", "part", "left", "key", "doc_id").agg(F.sum("size").alias("unit"))
    upto = F.sum("unit").over(Window.partitionBy("src", "part").orderBy("key", F.col("doc_id").asc_nulls_first()))
    units = units.withColumn("upto", upto)
    edge = units.where((F.col("upto") - F.col("unit") <= F.col("left")) & (F.col("left") < F.col("upto")))
    edge = edge.select(
        "src",
        F.col("key").alias("cut_key"),
        F.col("doc_id").alias("cut_id"),
        (F.col("left") - F.col("upto") + F.col("unit")).alias("cut_words"),
        F.col("unit").alias("cut_size"),
    )
    return goal.join(edge, "src", "left")


def _taken(size: Column, key: Column, doc_id: Column) -> Column:
    """Words taken from a row, beside the columns of ``cuts``."""
    earlier = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (doc_id < F.col("cut_id")))
    at_cut = (key == F.col("cut_key")) & doc_id.eqNullSafe(F.col("cut_id"))
    part = F.expr("cut_size").cast("decimal(38,0)")
    share = F.floor(size.cast("decimal(19,0)") * F.col("cut_words").cast("decimal(19,0)") / part)
    rest = F.when(at_cut, share).when(earlier, size).otherwise(0)
    return (F.col("epochs") * size + rest).cast("long")


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``source`` for each row."""
    sized = written(sized_documents(docs))
    plan = written(cuts(sized, targets(sized, weights, share, cap)))
    rows = sized.withColumn("src", _source(F.col("source"))).join(plan, "src")
    taken = _taken(F.col("size"), _key(F.col("doc_id")), F.col("doc_id"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, whole_texts: bool = False
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    At a cut, the first words of a text; with ``whole_texts`` no text is cut: a row at the cut is taken or left by a
    hash of its text, with the share of its words that are due, so a source's words differ from its budget by less
    than that document (all rows of it, if an id is shared).  Copies of a row are then decided alike.

    Rows without words are kept once, since they cost nothing.  A repeated
    ``text`` keeps its white space; ``n_chars``, if there is one, follows a cut text.
    """
    columns = docs.columns
    sized = written(sized_documents(docs))
    plan = written(cuts(sized, targets(sized, weights, share, cap)))
    named = [f"_mix_{c}" for c in plan.columns]
    plan = plan.toDF(*named)
    row = {c: F.col(f"_row.`{c}`") for c in columns}
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"))
    rows = rows.withColumn("_size", n_words(row["text"]))
    rows = rows.join(plan, _source(row["source"]) == F.col("_mix_src"))
    rows = rows.select("_row", "_size", *[F.col(a).alias(b) for a, b in zip(named, cuts_columns(plan, named))])
    rows = rows.withColumn("_taken", _taken(F.col("_size"), _key(row["doc_id"]), row["doc_id"]))
    whole = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size"))).otherwise(1)
    left = F.when(F.col("_size") > 0, F.col("_taken") % F.col("_size")).otherwise(0)
    if whole_texts:
        at_cut = (_key(row["doc_id"]) == F.col("cut_key")) & row["doc_id"].eqNullSafe(F.col("cut_id"))
        due = F.pmod(F.xxhash64(row["text"]), F.col("cut_size")) < F.col("cut_words")
        whole = F.when((F.col("_size") > 0) & at_cut, F.col("epochs") + due.cast("long")).otherwise(whole)
        left = F.lit(0).cast("long")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.filter(F.array(left), lambda n: n > 0))
    rows = rows.select("_row", F.explode(copies).alias("_words"))
    chunks = F.split(row["text"], r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(row["text"].rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(chunks, F.lit(1), (F.col("_words") + lead).cast("int")), "")
    text = F.when(F.col("_words") > 0, cut).otherwise(row["text"])
    row = row | {"text": text}
    if "n_chars" in row:
        row["n_chars"] = F.when(F.col("_words") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(
            row["n_chars"]
        )
    return rows.select(*[row[c].alias(c) for c in columns])


def cuts_columns(plan: DataFrame, named: list[str]) -> list[str]:
    return [c.removeprefix("_mix_") for c in named]
