"""Operator 1: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters and digits and of other scripts' bytes, in lower case. A text has each of its hashed words, word pairs and pairs with one
word between as a feature once. Training keeps the sums that FTRL-proximal needs for each coordinate; each coordinate has its own rate, and the L1 term leaves
few weights other than zero, which are all that is broadcast for scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import by_key, documents
from .shards import SENT, dealt, sent, summed
from .words import MARKS, hashed, mix, row_of

#: Hashed feature space; model and sums have this size at most.
BUCKETS = 1 << 20
#: Bound of the training sample: labelled rows with the smallest hashes of their id.
TRAIN_ROWS = 16_000
#: Shards that train side by side in each round, and rounds; the sums of the shards are averaged after each.
SHARDS, ROUNDS = 4, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.0
#: Rate of label 1 that counts as one labelled text more: what is known without labels.
RATE = 0.05
#: A text is predicted toxic from this score on.
THRESHOLD = 0.3
_BIAS = np.uint64(0)


def features(column) -> tuple:
    """For runs of rows: (first row, end row, row of each feature, bucket of each feature), with repeats."""
    for i, j, h, first in hashed(column, MARKS):
        row = row_of(first)
        parts_r, parts_h = [row, np.arange(j - i)], [h, np.full(j - i, _BIAS)]
        for gap, salt in ((1, 0x51ED27), (2, 0xA3B195)):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                parts_r.append(row[gap:][same])
                parts_h.append(mix(h[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + h[gap:][same] + np.uint64(salt)))
        b = (np.concatenate(parts_h) >> np.uint64(8)) % np.uint64(BUCKETS)
        yield i, j, np.concatenate(parts_r), b.astype(np.int64)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The proximal step: zero within the L1 bound, else shrunk and scaled by the coordinate's own rate."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _shard(start, offset: float):
    """One pass of FTRL over each shard's rows from the given sums; gives which coordinates it touched, and their new sums."""

    def run(batches):
        for shard, own in by_key(batches, "shard"):
            z, n = (x.astype(np.float64) for x in start.value)
            touched = np.zeros(BUCKETS, bool)
            for batch in own:
                y = batch.column("y").to_numpy()
                for i, j, row, b in features(batch.column("text")):
                    pairs = np.unique(row * BUCKETS + b)
                    row, b = pairs // BUCKETS, pairs % BUCKETS
                    touched[b] = True
                    edges = np.searchsorted(row, np.arange(j - i + 1))
                    for k in range(j - i):
                        step(z, n, b[edges[k] : edges[k + 1]], y[i + k], offset)
            yield sent(shard, np.stack([touched, z * touched, n * touched], 1).ravel())

    return run


def step(z: np.ndarray, n: np.ndarray, f: np.ndarray, y: float, offset: float = 0.0) -> None:
    """One text, with features ``f`` of value 1 and label ``y``, adds its gradient to the sums; ``offset`` is part of every margin."""
    w = weights(z[f], n[f])
    g = 1 / (1 + np.exp(-np.clip(offset + w.sum(), -35, 35))) - y
    rate = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
    z[f] += g - rate * w
    n[f] += g * g


def fit(rows: DataFrame, text: str = "text", label: str = "y") -> dict:
    """The trained weights that aren't zero, as arrays ``at`` and ``w``, and ``offset``. ``rows``: a bounded number of texts with labels 0 or 1; null labels don't count, null texts are empty.

    The offset is the log odds of the labels' rate, so L1 doesn't hold it at even odds; the rate has one text of ``RATE`` more than there are. Rows are dealt to shards, and put in order
    there, by a hash of text and label, so ties and repeated rows train alike on any cluster. With few labels, or one label only, weights are few or none, and scores are near
    the label's rate; without rows every text scores ``RATE``, so none is predicted toxic.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("double").alias("y"))
    rows = dealt(rows.withColumn("h", F.xxhash64("text", "y")), SHARDS, F.pmod("h", F.lit(SHARDS)), ["h", "text"]).select("shard", "text", "y").persist()
    known = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("ones")).first()
    rate = (known.ones + RATE) / (known.n + 1)
    offset = float(np.log(rate / (1 - rate)))
    z, n = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for _ in range(ROUNDS):
        start = spark.sparkContext.broadcast((z, n))  # BUCKETS numbers each
        total = summed(rows.mapInArrow(_shard(start, offset), SENT), SHARDS)
        start.destroy()
        if total is not None:
            seen, *new = total.reshape(-1, 3).T
            # Mean over the shards that saw the coordinate.
            z, n = (np.where(seen > 0, x / np.maximum(seen, 1), old).astype(np.float32) for x, old in zip(new, (z, n), strict=True))
    rows.unpersist()
    w = weights(z.astype(np.float64), n.astype(np.float64))
    at = np.flatnonzero(w)
    return {"at": at, "w": w[at], "offset": offset}


def score(docs: DataFrame, model: dict, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``: the probability of label 1 (double), which replaces a column of that name. Other columns pass through.

    Nulls score as empty texts, by offset and bias alone; all words of long texts count; repeated rows, and so ties, score alike and stay; an empty table gives an empty result.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # nonzero weights, BUCKETS at most
    kept = [f for f in docs.schema if f.name != into]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{into}` double"])

    def run(batches):
        w = np.zeros(BUCKETS)
        w[known.value["at"]] = known.value["w"]
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, row, b in features(batch.column(batch.schema.get_field_index(text))):
                some = np.flatnonzero(w[b])
                pairs = np.unique(row[some] * BUCKETS + b[some])
                total = np.bincount(pairs // BUCKETS, w[pairs % BUCKETS], j - i)
                out[i:j] = 1 / (1 + np.exp(-np.clip(known.value["offset"] + total, -35, 35)))
            keep = [i for i, name in enumerate(batch.schema.names) if name != into]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out)], [*(batch.schema.names[i] for i in keep), into])

    return docs.mapInArrow(run, schema)


def fold(id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; -1 for a null id, which so is in no fold that a query holds out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % parts, F.lit(-1))


def labelled(docs: DataFrame, labels: DataFrame, label: str, use, rows: int) -> DataFrame:
    """(text, y): at most ``rows`` labelled documents, those with the smallest hashes of their id among those that ``use`` lets in."""
    some = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & use).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y")


def train_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(labelled(docs, labels, "toxic", fold("doc_id", 4) != 2, TRAIN_ROWS))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = score(docs, train_toxicity(spark, docs, sf_dir)).drop("text")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
