"""Operator 2: a quality classifier by positive-unlabelled learning.

A linear model is trained on trusted positives and unlabelled texts only: it minimises the non-negative unbiased risk
``p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])`` with the logistic loss, where ``p`` is the class prior, estimated as the share of
positives among the labelled training rows; that is right as far as labels are a random sample of the documents. Features are frequencies of character-shape trigrams and hashed words, and bins of length and variety.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import by_key, documents
from .shards import SENT, dealt, sent, summed
from .toxicity import fold
from .words import LOWER, SPACES, find_words, hash_words, row_of, slices

#: Bound of the trusted positives: labelled rows with the smallest hashes of their id. All unlabelled texts are used.
POSITIVE_ROWS = 6_000
#: Unlabelled rows and positives of a shard, about; rounds, after each of which the shards' weights are averaged; every text is in one round.
SHARD_ROWS, SHARD_POSITIVES, ROUNDS = 4096, 512, 2
EPOCHS, STEPS, BATCH = 3, 96, 64
RATE, DECAY, SCALE = 0.3, 1e-5, 12.0
THRESHOLD = 0.5

_KINDS = 48
_SHAPE = np.zeros(256, np.int32)  # letters, capitals, digits, blanks, line ends, and each mark on its own
for _c in range(256):
    _ch = chr(_c)
    _SHAPE[_c] = 1 if _c >= 128 or _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 4 if _ch == " " else 5 if _ch == "\n" else 6
for _i, _ch in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _SHAPE[ord(_ch)] = 7 + _i
TRIGRAMS, WORDS, BINS = _KINDS**3, 1 << 16, 64
SIZE = TRIGRAMS + WORDS + BINS + 1


def _occurrences(column):
    """For runs of rows: (first row, end row, trigrams, their place, rows' places, words, first word of each row, bins (two a row))."""
    for i, j, data, offsets in slices(column):
        c = _SHAPE[data]
        tri = c[:-2] * (_KINDS * _KINDS) + c[1:-1] * _KINDS + c[2:] if len(c) > 2 else np.zeros(0, np.int32)
        lower = LOWER[data]
        starts, ends, first = find_words(lower, offsets, SPACES)
        h = hash_words(lower, starts, ends)
        n = np.diff(first)
        row = row_of(first)
        keys = np.unique((h >> np.uint64(24) << np.uint64(24)) ^ row.astype(np.uint64))
        distinct = np.bincount((keys & np.uint64((1 << 24) - 1)).astype(np.int64), minlength=j - i)[: j - i] if len(h) else np.zeros(j - i)
        variety = np.where(n > 0, distinct / np.maximum(n, 1), 1.0)
        size = np.minimum(np.log2(n + 1), 15).astype(np.int64)
        bins = TRIGRAMS + WORDS + np.stack([np.minimum((variety * 30).astype(np.int64), 30), 32 + size], 1)
        yield i, j, tri, offsets, TRIGRAMS + ((h >> np.uint64(9)) % np.uint64(WORDS)).astype(np.int64), first, bins


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[hi] - total[lo]


def margins(column, w: np.ndarray):
    """(first row, end row, margin of each row)."""
    for i, j, tri, offsets, words, first, bins in _occurrences(column):
        lo, hi = offsets[:-1], np.maximum(offsets[1:] - 2, offsets[:-1])
        lo, hi = np.minimum(lo, len(tri)), np.minimum(hi, len(tri))
        t = _sums(w[tri], lo, hi) / np.maximum(hi - lo, 1)
        u = _sums(w[words], first[:-1], first[1:]) / np.maximum(np.diff(first), 1)
        yield i, j, SCALE * (t + u) + w[bins].sum(1) + w[-1]


def _rows(column):
    """(feature numbers, values) of each row."""
    for i, j, tri, offsets, words, first, bins in _occurrences(column):
        for k in range(j - i):
            t = tri[offsets[k] : max(offsets[k], offsets[k + 1] - 2)]
            u = words[first[k] : first[k + 1]]
            ft, ct = np.unique(t, return_counts=True)
            fu, cu = np.unique(u, return_counts=True)
            at = np.concatenate([ft, fu, bins[k], [SIZE - 1]])
            yield at, np.concatenate([SCALE * ct / max(1, len(t)), SCALE * cu / max(1, len(u)), np.ones(3)])


def gradient(at: np.ndarray, x: np.ndarray, of: np.ndarray, w: np.ndarray, n_pos: int, prior: float) -> tuple[np.ndarray, float]:
    """(derivative of the risk by each row's margin, the negative class's risk) of a batch: features ``at`` with values ``x`` of rows ``of``, the first ``n_pos`` of them positive.

    Where the negative class's risk is below zero, which it can't be, the step goes back from what made it so.
    """
    n = int(of[-1]) + 1
    f = np.clip(np.bincount(of, x * w[at], n), -30, 30)
    s = 1 / (1 + np.exp(-f))
    negative = np.logaddexp(0, f[n_pos:]).mean() - prior * np.logaddexp(0, f[:n_pos]).mean()
    if negative >= 0:
        return np.concatenate([np.full(n_pos, -prior / n_pos), s[n_pos:] / (n - n_pos)]), negative
    return np.concatenate([prior * s[:n_pos] / n_pos, -s[n_pos:] / (n - n_pos)]), negative


def _train(pos: list, unl: list, w0: np.ndarray, number: int, prior: float) -> np.ndarray:
    """The weights after a shard's steps: its unlabelled rows ``EPOCHS`` times, or ``STEPS`` steps if that is more."""
    rng = np.random.default_rng(7919 + number)
    w, seen = w0.copy(), np.full(SIZE, 1e-3)
    steps = max(STEPS, EPOCHS * -(-len(unl) // (2 * BATCH)))
    order = lambda n, size: np.concatenate([rng.permutation(n) for _ in range(-(-steps * size // n))])
    order_p, order_u = order(len(pos), BATCH), order(len(unl), 2 * BATCH)
    for k in range(steps):
        some = [pos[i] for i in order_p[k * BATCH : (k + 1) * BATCH]] + [unl[i] for i in order_u[2 * k * BATCH : 2 * (k + 1) * BATCH]]
        at, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
        of = np.repeat(np.arange(len(some)), [len(r[0]) for r in some])
        g, _ = gradient(at, x, of, w, BATCH, prior)
        names, place = np.unique(at, return_inverse=True)
        d = np.bincount(place, x * g[of], len(names)) + DECAY * w[names]
        seen[names] += d * d
        w[names] -= RATE * d / np.sqrt(seen[names])
    return w


def _shards(start, prior: float):
    """Each shard's weights after its steps, times its unlabelled rows, and the number of these behind them."""

    def run(batches):
        for number, own in by_key(batches, "shard"):
            sets: dict[bool, list] = {True: [], False: []}
            for batch in own:
                for positive, row in zip(batch.column("positive").to_pylist(), _rows(batch.column("text")), strict=True):
                    sets[positive].append(row)
            if sets[True] and sets[False]:
                n = len(sets[False])
                yield sent(number, np.append(_train(sets[True], sets[False], start.value, number, prior) * n, n))

    return run


def fit(positives: DataFrame, unlabelled: DataFrame, prior: float) -> np.ndarray:
    """Weights from texts (columns text and, if there is one, doc_id) of both kinds: a bounded number of positives, and any number of unlabelled ones, all of which are used.

    Unlabelled rows are dealt by a hash of their text and id to shards of about ``SHARD_ROWS``, and each shard gets about ``SHARD_POSITIVES`` of the positives; the shards of a
    round train side by side and are averaged by rows. So the model doesn't depend on the cluster. Nulls are empty texts; without either kind all weights are 0, and so all scores 0.5.
    """
    spark = positives.sparkSession
    shards = ROUNDS * max(1, -(-unlabelled.count() // (ROUNDS * SHARD_ROWS)))
    groups = min(shards, max(1, positives.count() // SHARD_POSITIVES))
    # Copies of a text have ids of their own, so they don't meet in one shard.
    of = lambda d: F.xxhash64(F.coalesce("text", F.lit("")), *(["doc_id"] if "doc_id" in d.columns else []))
    text = F.coalesce("text", F.lit("")).alias("text")
    good = positives.select(text, F.lit(True).alias("positive"), of(positives).alias("h"), F.explode(F.sequence(F.pmod(of(positives), F.lit(groups)), F.lit(shards - 1).cast("long"), F.lit(groups).cast("long"))).alias("to"))
    rest = unlabelled.select(text, F.lit(False).alias("positive"), of(unlabelled).alias("h"), F.pmod(F.shiftright(of(unlabelled), 20), F.lit(shards)).alias("to"))
    rows, w = good.unionByName(rest), np.zeros(SIZE)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(w)  # SIZE numbers
        mine = dealt(rows.filter(F.col("to") % ROUNDS == turn), shards // ROUNDS, F.expr(f"to div {ROUNDS}"), ["h", "positive", "text"])
        total = summed(mine.select("shard", "text", "positive").mapInArrow(_shards(start, prior), SENT), shards // ROUNDS)
        start.destroy()
        w = w if total is None else total[:-1] / total[-1]
    return w


def score(docs: DataFrame, w: np.ndarray, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``: the probability of good quality (double), which replaces a column of that name. Other columns pass through.

    Nulls score as empty texts, by their bins alone; whole texts count; repeated rows score alike and stay; an empty table gives an empty result.
    """
    known = docs.sparkSession.sparkContext.broadcast(w)  # SIZE numbers
    kept = [f for f in docs.schema if f.name != into]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{into}` double"])

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, m in margins(batch.column(batch.schema.get_field_index(text)), known.value):
                out[i:j] = 1 / (1 + np.exp(-np.clip(m, -35, 35)))
            keep = [k for k, name in enumerate(batch.schema.names) if name != into]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out)], [*(batch.schema.names[k] for k in keep), into])

    return docs.mapInArrow(run, schema)


def train_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> np.ndarray:
    """Positives and prior from the labels of the training fold; unlabelled texts are all documents of that fold, whatever their label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    good = F.broadcast(labels.filter("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVE_ROWS))
    learn = docs.filter(fold("doc_id", 3) != 1).select("doc_id", "text")
    return fit(learn.join(good, "doc_id"), learn, 0.5 if prior is None else float(np.clip(prior, 0.01, 0.99)))


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = score(docs, train_quality(spark, docs, sf_dir)).drop("text")
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
