"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Tokens are lower-cased words and an end.  The ``TOP`` most frequent training words
are symbols of their own, the other words share ``SHARED`` symbols by hash, the end
is one.  Latent states emit symbols; within a shared symbol a word has its share
of the symbol's training counts, one added to each word and one kept for unknown
words.  So the tables of the states have a fixed size, and the number of words
does not matter to what is sent to the executors; counts of all words stay in a
table that is joined.

Training: word counts over all training texts; then ``STEPS`` Baum-Welch steps, each
over all of them at any size, expected counts summed per task and then over all tasks.  Training sequences are
blocks of at most ``BLOCK`` tokens.  Scores use the scaled forward recursion over
whole texts, which gives the exact probability of the sequence.

Words are known by 64-bit hashes.  Words among the ``COUNTED`` most frequent are
looked up where they occur, the rest meet their counts in a join, which so has no
hot keys.

Defined cases: a null or empty text is the end token only; a null ``doc_id`` counts
as training, like an empty one; repeated rows each count and each get a score;
without training texts every token is unknown and all have the same probability;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.words import U, each_slice
from pagequarry.sources.lineage import written

STATES = 8
TOP, SHARED = 4096, 1024
SYMBOLS = TOP + SHARED + 1
END = SYMBOLS - 1
#: Words whose counts every executor holds: 2.4 MB.
COUNTED = 200_000
#: Baum-Welch steps, each over all training texts.
STEPS = 10
BLOCK = 512
BATCH_TOKENS = 1 << 17
#: Pseudo-counts of the overall distribution in each state, and of each transition.
PRIOR, MOVE_PRIOR = 50.0, 1.0


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


def is_training(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != fold


# ---------------------------------------------------------------- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [w.hashes for _, _, w in each_slice(batch.column(0))]
        words, counts = np.unique(np.concatenate(hashes or [np.zeros(0, U)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "count"])


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, count`` of the texts, words as hashes; summed within batches first."""
    return texts.select("text").mapInArrow(_count, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


@dataclass
class Vocabulary:
    """What every executor knows about words."""

    words: np.ndarray  # the counted words, ascending
    counts: np.ndarray
    symbols: np.ndarray  # of the counted words
    shared: np.ndarray  # sum of count + 1 over the words of each shared symbol, and one
    tokens: int
    distinct: int
    docs: int

    def symbol_shares(self) -> np.ndarray:
        """The overall distribution of symbols."""
        mass = np.zeros(SYMBOLS)
        top = self.symbols < TOP
        mass[self.symbols[top]] = self.counts[top] + 1.0
        mass[TOP:END] = self.shared
        mass[END] = self.docs + 1.0
        # symbols of missing top words are never used
        return mass / mass.sum()


def vocabulary(counts: DataFrame, docs: int) -> Vocabulary:
    """The bounded part of a written table of counts."""
    total = counts.agg(F.sum("count").alias("n"), F.count("*").alias("v")).first()
    # the least frequency, in steps of 1/16 of a power of two, above which there are few enough words
    level = F.floor(F.log2("count") * 16)
    words_at, least, seen = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), 1 << 20, 0
    for r in sorted(words_at, reverse=True):
        seen += r.n
        if seen <= COUNTED:
            least = r.level
    frequent = sorted(counts.where(level >= least).collect(), key=lambda r: (-r["count"], r.word))
    words = np.array([r.word for r in frequent], np.int64).view(U)
    sums = np.array([r["count"] for r in frequent], np.int64)
    symbols = np.where(np.arange(len(words)) < TOP, np.arange(len(words)), TOP + (words % U(SHARED)).astype(np.int64))
    shared = np.ones(SHARED)
    # hashes are unsigned; their low bits name the shared symbol
    low = F.col("word").bitwiseAND(F.lit(SHARED - 1))
    for r in counts.groupBy(low.alias("low")).agg(F.sum(F.col("count") + 1).alias("mass")).collect():
        shared[r.low] += r.mass
    np.subtract.at(shared, (words[:TOP] % U(SHARED)).astype(np.int64), sums[:TOP] + 1.0)
    order = np.argsort(words)
    return Vocabulary(
        words[order], sums[order], symbols[order].astype(np.int64), shared,
        int(total.n or 0) + docs, total.v + (docs > 0), docs,
    )


# ---------------------------------------------------------------- symbols

_CODED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_shared double,"
    " symbols binary, rare_words array<bigint>, rare_counts array<bigint>"
)


def _coded(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = sent.value, TaskContext.get().partitionId() << 40
        log_count = np.log10(v.counts + 1.0)
        log_shared = np.concatenate((np.zeros(TOP), np.log10(v.shared)))
        end_log = math.log10(v.docs + 1.0)
        for batch in batches:
            for lo, hi, words in each_slice(batch.column(1)):
                h = words.hashes
                at = np.minimum(np.searchsorted(v.words, h), max(len(v.words) - 1, 0))
                known = v.words[at] == h if len(v.words) else np.zeros(len(h), bool)
                symbols = TOP + (h % U(SHARED)).astype(np.int64)
                logs = np.zeros(len(h))
                if len(v.words):
                    symbols[known] = v.symbols[at[known]]
                    logs[known] = log_count[at[known]]
                sums = {}
                own = np.where(symbols < TOP, logs, 0.0)  # words that are symbols are no part of one
                for name, x in (("known", known), ("logs", logs), ("own", own), ("shared", log_shared[symbols])):
                    sums[name] = np.diff(np.concatenate(([0.0], np.cumsum(x)))[words.first])
                rare_words, rare_counts, blobs = [], [], []
                for a, b in zip(words.first[:-1], words.first[1:]):
                    some, n = np.unique(h[a:b][~known[a:b]], return_counts=True)
                    rare_words.append(some.view(np.int64))
                    rare_counts.append(n)
                    blobs.append(np.append(symbols[a:b], END).astype("<u2").tobytes())
                n = hi - lo
                ids = batch.column(0).slice(lo, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        ids,
                        pa.array([held_out(i) for i in ids.to_pylist()]),
                        pa.array(words.counts() + 1),
                        pa.array(sums["known"].astype(np.int64) + (v.docs > 0)),
                        pa.array(sums["logs"] + end_log),
                        pa.array(-sums["own"] - end_log - sums["shared"]),
                        pa.array(blobs, pa.binary()),
                        pa.array(rare_words, pa.list_(pa.int64())),
                        pa.array(rare_counts, pa.list_(pa.int64())),
                    ],
                    names=[c.split()[0] for c in _CODED.split(",")],
                )
                row += n

    return run


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray  # from, to
    emit: np.ndarray  # symbol, state


def first_model(shares: np.ndarray) -> Model:
    """States that differ at random, but always in the same way, and tend to stay."""
    noise = np.random.default_rng(7).gamma(1.0, size=(SYMBOLS, STATES)) + 0.05
    emit = shares[:, None] * noise
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def _batches(sequences: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Longest first, so that those still running are always the first ones."""
    sequences = sorted(sequences, key=len, reverse=True)
    lo = 0
    while lo < len(sequences):
        hi = lo + max(1, BATCH_TOKENS // len(sequences[lo]))
        yield sequences[lo:hi]
        lo = hi


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by time and sequence, and how many sequences run at each time."""
    lengths = np.array([len(s) for s in sequences])
    out = np.full((lengths[0], len(sequences)), END, np.int64)
    for i, s in enumerate(sequences):
        out[: len(s), i] = s
    return out, np.searchsorted(-lengths, -np.arange(lengths[0]), "left")


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each sequence, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]), reverse=True)
    emit, move = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    done = 0
    for group in _batches(sequences):
        symbols, running = _padded(group)
        logs = np.zeros(len(group))
        alpha = np.broadcast_to(model.start[:, None], (STATES, len(group)))
        for t, n in enumerate(running):
            alpha = (alpha[:, :n] if t == 0 else move @ alpha[:, :n]) * emit.take(symbols[t, :n], axis=1)
            scale = alpha.sum(0)
            alpha /= scale
            logs[:n] += np.log10(scale)
        out[order[done : done + len(group)]] = logs
        done += len(group)
    return out


class Expected:
    """Expected counts of starts, moves and emissions.

    Arrays have the states in front and the sequences last, so that each operation runs
    over long rows.  Within a batch numbers have single precision, each is scaled to
    the sequence's position; sums over tokens have double precision.
    """

    def __init__(self):
        self.start, self.move, self.emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))

    def add(self, model: Model, sequences: list[np.ndarray]) -> None:
        one = np.float32
        emit = np.ascontiguousarray(model.emit.T, one)
        onward, back = np.ascontiguousarray(model.move.T, one), np.ascontiguousarray(model.move, one)
        for group in _batches(sequences):
            symbols, running = _padded(group)
            steps, width = symbols.shape
            emitted = np.empty((STATES, steps, width), one)
            for s in range(STATES):
                emit[s].take(symbols, out=emitted[s], mode="clip")
            alpha, over = np.zeros((steps, STATES, width), one), np.ones((steps, width), one)
            now = np.broadcast_to(model.start.astype(one)[:, None], (STATES, width))
            for t, n in enumerate(running):
                now = (now if t == 0 else onward @ now[:, :n]) * emitted[:, t, :n]
                over[t, :n] = 1 / now.sum(0)
                now *= over[t, :n]
                alpha[t, :, :n] = now
            # ahead: beta times emission over scale, of the running sequences only
            beta, ahead, moves = np.ones((STATES, width), one), None, np.zeros((STATES, STATES))
            for t in range(steps - 1, -1, -1):
                n = running[t]
                if ahead is not None:
                    m = ahead.shape[1]
                    moves += alpha[t, :, :m] @ ahead.T
                    beta[:, :m] = back @ ahead
                ahead = emitted[:, t, :n] * beta[:, :n]
                ahead *= over[t, :n]
                np.multiply(alpha[t, :, :n], beta[:, :n], out=emitted[:, t, :n])  # from here on the posterior
                emitted[:, t, n:] = 0
            self.start += emitted[:, 0].sum(1, dtype=np.float64)
            self.move += model.move * moves
            flat = symbols.ravel()
            for s in range(STATES):
                self.emit[:, s] += np.bincount(flat, emitted[s].ravel(), SYMBOLS)


def _training(sent):
    """Rows ``kind, at, s0, s1, ...`` of a task's expected counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, expected = sent.value, Expected()
        for batch in batches:
            blocks, size = [], 0
            for blob in batch.column(0).to_pylist():
                s = np.frombuffer(blob, "<u2")
                blocks += [s[i : i + BLOCK] for i in range(0, len(s), BLOCK)]
                size += len(s)
                if size >= 8 * BATCH_TOKENS:
                    expected.add(model, blocks)
                    blocks, size = [], 0
            if blocks:
                expected.add(model, blocks)
        rows = np.vstack((expected.start, expected.move, expected.emit))
        columns = [pa.array(np.arange(len(rows)))] + [pa.array(np.ascontiguousarray(c)) for c in rows.T]
        yield pa.RecordBatch.from_arrays(columns, names=["at", *_STATE_NAMES])

    return run


_STATE_NAMES = [f"s{i}" for i in range(STATES)]


def _step(model: Model, sequences: DataFrame, shares: np.ndarray) -> Model:
    """One Baum-Welch step over ``symbols``; what comes back has a fixed size."""
    sent = sequences.sparkSession.sparkContext.broadcast(model)
    schema = "at long, " + ", ".join(f"{n} double" for n in _STATE_NAMES)
    sums = sequences.select("symbols").mapInArrow(_training(sent), schema)
    sums = sums.groupBy("at").agg(*[F.sum(n).alias(n) for n in _STATE_NAMES])
    rows = np.zeros((1 + STATES + SYMBOLS, STATES))
    for r in sums.collect():
        rows[r[0]] = r[1:]
    sent.unpersist()
    start = rows[0] + MOVE_PRIOR
    move = rows[1 : 1 + STATES] + MOVE_PRIOR
    emit = rows[1 + STATES :] + PRIOR * shares[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(coded: DataFrame, v: Vocabulary) -> Model:
    shares = v.symbol_shares()
    model = first_model(shares)
    sequences = coded.where("not held_out")
    if not v.docs:
        return model
    for _ in range(STEPS):
        model = _step(model, sequences, shares)
    return model


def _likelihoods(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.frombuffer(b, "<u2") for b in batch.column(batch.num_columns - 1).to_pylist()]
            scores = log_likelihoods(sent.value, sequences)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=_SCORED)

    return run


_SCORED = ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "log_shared", "log_symbols"]


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.where(is_training(F.col("doc_id")))
    counts = written(word_counts(training))
    v = vocabulary(counts, training.select("doc_id").count())
    coded = written(docs.mapInArrow(_coded(spark.sparkContext.broadcast(v)), _CODED))
    model = train(coded, v)

    # of words that are not looked up locally, only known ones add to the sums
    rare = coded.select("row", F.explode(F.arrays_zip("rare_words", "rare_counts")).alias("r"))
    rare = rare.select("row", F.col("r.rare_words").alias("word"), F.col("r.rare_counts").alias("n"))
    rare = rare.join(counts, "word").groupBy("row")
    rare = rare.agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("count") + 1.0)).alias("more_logs"))

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_shared double, log_symbols double"
    rows = coded.select(*_SCORED[:-1], "symbols").mapInArrow(_likelihoods(spark.sparkContext.broadcast(model)), schema)
    rows = rows.join(rare, "row", "left").na.fill(0, ["more"]).na.fill(0.0, ["more_logs"])
    log_total = math.log10(v.tokens + v.distinct + 1)
    logs = F.col("log_counts") + F.col("more_logs")
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(log_total)).alias("base_score"),
        (F.col("log_symbols") + logs + F.col("log_shared")).alias("score"),
    )
