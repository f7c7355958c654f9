"""Quality rules: counts of words, lines and repeats, and how likely a text is in trusted rather than raw text.

The verdict of the model is a log-likelihood ratio.  Words and pairs of words are
hashed to ``BUCKETS`` buckets; one multinomial over them is counted on trusted
documents, one on all.  A document's score is the mean, over its n-grams, of the
difference of the two log probabilities, so length does not matter, and it stays
if that is at least ``THRESHOLD``.

Trusted documents are those labelled good and not toxic; at most ``TRUSTED`` of
them, the first by hash, make the trusted model, which bounds what is sent to the
executors.  The raw model and the scores cover all documents.

All of it is SQL functions; a document is never taken apart into rows except for
counting buckets, which are aggregated before the shuffle.

Defined cases: a null or empty text has no words and fails the base rules; a
score without n-grams is 0; without labels both models are equal and only base
rules decide; rows that repeat are each counted and each returned; other columns
are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.arrays import with_once
from pagequarry.llm.words import SPACE_CHARS, SPACES

BUCKETS = 1 << 16
SMOOTHING = 5.0
TRUSTED = 20_000
#: Nats per n-gram.
THRESHOLD = -0.2
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(bare) > 0, F.split(bare, SPACES)).otherwise(F.array().cast("array<string>"))


def _pairs(words: Column) -> Column:
    """Hashes of pairs of neighbours, in order."""
    rest = F.when(F.size(words) > 1, F.slice(words, 2, F.size(words))).otherwise(F.array().cast("array<string>"))
    return F.transform(rest, lambda w, i: F.xxhash64(F.get(words, i), w))


def _windows(pairs: Column) -> Column:
    """Hashes of the three-word windows, in order, each made of its two pairs."""
    rest = F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1)))
    return F.when(F.size(pairs) > 1, F.transform(rest, lambda p, i: F.xxhash64(F.get(pairs, i), p)))


#: Bits of a window's place beside the high bits of its hash.
PLACE_BITS = 31


def _neighbours(sorted_: Column, value) -> Column:
    """The elements with a neighbour of equal value."""

    def twice(w: Column, k: Column) -> Column:
        after, before = value(F.get(sorted_, k + 1)) == value(w), value(F.get(sorted_, k - 1)) == value(w)
        return F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))

    return F.filter(sorted_, twice)


def _repeated(rows: DataFrame) -> DataFrame:
    """``_places``: places of the ``_windows`` found twice, ascending.

    Texts without an equal hash are done.  In others half of each hash and the place are sorted as one number; only
    what has an equal neighbour there is sorted by its whole hash.
    """
    windows, none = F.col("_windows"), F.array().cast("array<bigint>")
    packed = F.transform(windows, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    rows = with_once(rows, "_packed", F.when(some, F.sort_array(packed)).otherwise(none))
    near = _neighbours(F.col("_packed"), lambda w: F.shiftright(w, PLACE_BITS))
    place = lambda w: w.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    whole = F.transform(near, lambda w: F.struct(F.get(windows, place(w)).alias("h"), place(w).alias("i")))
    rows = with_once(rows, "_near", F.sort_array(whole))
    places = F.transform(_neighbours(F.col("_near"), lambda w: w["h"]), lambda w: w["i"])
    return with_once(rows, "_places", F.sort_array(places))


def _covered(places: Column) -> Column:
    """Size of the union of ``{p, p + 1, p + 2}`` over ascending places."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))

    def add(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"), p.alias("last"))

    return F.coalesce(F.aggregate(places, start, add, lambda acc: acc["n"]), F.lit(0).cast("long"))


def _grams(words: Column, pairs: Column) -> Column:
    """Buckets of all words and pairs of neighbours."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    return F.concat(F.transform(words, lambda w: bucket(F.xxhash64(w))), F.transform(pairs, bucket))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """At most ``most`` documents labelled good and not toxic."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with ``ratio``: an array with the log-likelihood ratio of each bucket."""
    spark = docs.sparkSession
    trusted = F.broadcast(trusted_ids(labels).select(F.col("doc_id").alias("_trusted")))
    rows = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("_trusted"), "left")
    rows = with_once(rows.select("_trusted", "text"), "_words", words_of(F.col("text")))
    grams = rows.select("_trusted", F.explode(_grams(F.col("_words"), _pairs(F.col("_words")))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("good"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").na.fill(0)
    totals = counts.agg(F.collect_list(F.struct("bucket", "raw", "good")).alias("c"), F.sum("raw").alias("r"), F.sum("good").alias("g"))

    def log_share(n: Column, total: Column) -> Column:
        return F.log((n + F.lit(SMOOTHING)) / (total + F.lit(SMOOTHING * BUCKETS)))

    ratio = F.transform(
        F.sort_array("c"),
        lambda b: F.when(F.col("g") > 0, log_share(b["good"], F.col("g")) - log_share(b["raw"], F.col("r"))).otherwise(0.0),
    )
    return totals.select(ratio.alias("ratio"))


def _constant(ratio: DataFrame) -> Column:
    """The array as a constant of the plan: ``BUCKETS`` numbers, whatever the corpus; lambdas take no subqueries."""
    numbers = ",".join(f"{x:.6g}" for x in ratio.first()[0])
    return F.from_json(F.lit(f"[{numbers}]"), "array<double>")


def _measured(rows: DataFrame, text: Column, ratio: Column) -> DataFrame:
    """``rows`` with ``_words`` and the columns of ``quality``, named with a leading underscore."""
    rows = with_once(rows, "_words", words_of(text))
    rows = with_once(rows, "_pairs", _pairs(F.col("_words")))
    rows = _repeated(with_once(rows, "_windows", _windows(F.col("_pairs"))))
    rows = with_once(rows, "_grams", _grams(F.col("_words"), F.col("_pairs")))
    words, grams = F.col("_words"), F.col("_grams")
    blank = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(blank, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    rows = with_once(rows, "_lines", lines)
    rows = rows.select(
        "*",
        F.size(words).cast("long").alias("_n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("_word_chars"),
        (F.length(blank) - F.length(F.regexp_replace(blank, SYMBOLS, ""))).cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        _covered(F.col("_places")).alias("_n_repeat_words"),
        F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(ratio, b)).alias("_sum"),
        F.size(grams).alias("_n_grams"),
    )
    rows = rows.withColumn("_score", F.when(F.col("_n_grams") > 0, F.col("_sum") / F.col("_n_grams")).otherwise(0.0))
    few = F.col("_n_words") < LEAST_WORDS
    repeats = 100 * F.col("_n_repeat_words") > MOST_REPEATED_PERCENT * F.col("_n_words")
    rows = rows.withColumn("_base_failed", few | repeats)
    return rows.withColumn("_kept", ~F.col("_base_failed") & (F.col("_score") >= THRESHOLD))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score`` per row."""
    rows = docs.select("doc_id", "text")
    rows = _measured(rows, F.col("text"), _constant(ratios(docs, labels)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return rows.select("doc_id", *[F.col(f"_{n}").alias(n) for n in names])


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    rows = _measured(rows, F.col("_row.text"), _constant(ratios(docs, labels)))
    return rows.where("_kept").select("_row.*")
