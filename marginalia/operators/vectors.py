"""Nearest vectors for many questions at once: blocked matrix products, and only the best few of a question leave a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the questions that a task holds at once, about; more questions are more passes. Rows, and questions, that are multiplied at once.
BLOCK_NUMBERS, ROWS, ASKED = 1 << 22, 2048, 256


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def nearest(rows: DataFrame, questions: DataFrame, top: int = 10, vector: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, score, rank): for each question (query_id, ``vector``) the ``top`` rows (chunk_id string, ``vector``) by cosine to six places, ties by chunk_id; exact.

    Rows and questions whose vector is null or of another length than the questions' commonest are left out; zero vectors score 0; copies are rows of their own. Questions go to the tasks in
    blocks of a bounded size, dealt by hash. A task keeps the best ``top`` rows of each question, so what is shuffled grows with tasks and questions, not with pairs.
    """
    spark = rows.sparkSession
    asked = questions.filter(F.col(vector).isNotNull()).select("query_id", F.col(vector).cast("array<double>").alias("v"))
    size = asked.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()[:1]  # a row a length
    kind = questions.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, chunk_id string, score double"
    if not size:
        return spark.createDataFrame([], f"{schema}, rank int")
    d, n = size[0]["d"], size[0]["count"]
    blocks = max(1, -(-n * d // BLOCK_NUMBERS))
    some = rows.filter(F.size(vector) == d).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col(vector).cast("array<double>").alias("v"))
    found = None
    for k in range(blocks):
        own = asked.filter(F.size("v") == d) if blocks == 1 else asked.filter((F.size("v") == d) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k))
        mine = own.toArrow()  # a block
        if not mine.num_rows:
            continue
        numbers = mine["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        known = spark.sparkContext.broadcast((np.array([*mine["query_id"].to_pylist(), None], object)[:-1], _unit(numbers)))
        part = some.mapInArrow(_best(known, d, top, kind), schema)
        found = part if found is None else found.unionByName(part)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= top)


def _best(known, d: int, top: int, kind: str):
    def run(batches):
        ids, q = known.value
        names, scores = np.full((len(ids), top), "", object), np.full((len(ids), top), -np.inf)
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            for i in range(0, batch.num_rows, ROWS):
                own, unit = np.array(batch.column("chunk_id").slice(i, ROWS).to_pylist(), object), _unit(values[i : i + ROWS])
                place = np.argsort(np.argsort(own, kind="stable"), kind="stable")
                for k in range(0, len(ids), ASKED):
                    kept(names[k : k + ASKED], scores[k : k + ASKED], own, place, np.floor(q[k : k + ASKED] @ unit.T * 1e6 + 0.5) / 1e6)
        for k in range(0, len(ids), ASKED):
            row, col = np.nonzero(scores[k : k + ASKED] > -np.inf)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k + row].tolist()), pa.array(names[k + row, col].tolist(), pa.string()), pa.array(scores[k + row, col])], ["query_id", "chunk_id", "score"])

    return run


def kept(names: np.ndarray, scores: np.ndarray, own: np.ndarray, place: np.ndarray, s: np.ndarray) -> None:
    """Puts the columns of ``s`` (named ``own``, whose order is ``place``) among the best of each row, in place: by falling score, of equal scores those with the least names."""
    top = names.shape[1]
    edge = scores[:, -1]
    if s.shape[1] > top and np.isinf(edge).any():
        edge = np.maximum(edge, np.partition(s, -top, 1)[:, -top])
    row, col = np.nonzero(s >= edge[:, None])
    order = np.lexsort((place[col], -s[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < top
    row, col = row[first], col[first]
    some = np.unique(row)
    of = np.concatenate([np.repeat(some, top), row])
    all_names, all_scores = np.concatenate([names[some].ravel(), own[col]]), np.concatenate([scores[some].ravel(), s[row, col]])
    order = np.argsort(all_names, kind="stable")
    order = order[np.lexsort((-all_scores[order], of[order]))]
    of = of[order]
    order = order[np.arange(len(of)) - np.searchsorted(of, of) < top]
    names[some], scores[some] = all_names[order].reshape(-1, top), all_scores[order].reshape(-1, top)
