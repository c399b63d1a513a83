"""Operator 12: embedding whitening by cyclic Jacobi rotations.

Vectors become whole numbers, so their count and sums are exact. With these, tasks add up the scatter of centred vectors, a matrix of fixed size; the driver rotates pairs of axes
until the matrix is diagonal, which also gives its small eigenvalues with full relative accuracy; and the sorted, scaled eigenvectors go back to the tasks as the whitening matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shards import SENT, sent, summed

#: Fixed values of the contract: an entry c counts as floor(1024 * c) + 100000.
SCALE, SHIFT = 1024, 100_000
#: Entries of this size and beyond have no long of their own; vectors with such are left out.
LARGEST = 2.0**52
COMPONENTS = 8
#: Numbers of a matrix that a task works on at once; groups of tasks whose matrices are added first.
CELLS, GROUPS = 1 << 20, 1024
#: Beyond this share of the largest eigenvalue and the number of dimensions, an eigenvalue is rounding noise.
NOISE = 1e-14


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has finite entries only, none null and none of ``LARGEST``, and the dimension of most of them (of two, the smaller), which the others are left out for."""
    rows = rows.withColumn(vector, F.col(vector).cast("array<double>"))
    rows = rows.filter(F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    size = F.size(vector)
    most = rows.groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (rows.filter(size == most.d), most.d) if most else (rows, 0)


def _whole(column: pa.Array, d: int):
    """(first row, end row, whole numbers as a matrix) for runs of rows of an array column."""
    values, step = column.flatten().to_numpy(zero_copy_only=False), max(1, CELLS // max(1, d))
    for i in range(0, len(column), step):
        j = min(len(column), i + step)
        yield i, j, np.floor(values[i * d : j * d].reshape(j - i, d) * SCALE).astype(np.int64) + SHIFT


def totals(rows: DataFrame, vector: str, d: int) -> tuple[int, list[int]]:
    """(number of rows, sum of each dimension), exact whatever their size."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for _, _, x in _whole(batch.column(0), d):
                n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d)), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    made = rows.select(vector).mapInArrow(run, "i bigint, n bigint, high bigint, low bigint").groupBy("i")
    found = sorted(made.agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(30,0)")).alias(c) for c in ("high", "low")]).collect())  # a row a dimension
    return (found[0].n if found else 0), [(int(r.high) << 32) + int(r.low) for r in found]


def moments(rows: DataFrame, vector: str, d: int, width: int, values) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of ``values``, a function of matrices of whole vectors that gives ``width`` columns. Each task has one matrix, and tasks' matrices are added up by executors."""

    def run(batches):
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for _, _, x in _whole(batch.column(0), d):
                v = values(x)
                total += v.sum(0)
                products += v.T @ v
        yield sent(TaskContext.get().partitionId(), np.append(total, products.ravel()), np.float64)

    found = summed(rows.select(vector).mapInArrow(run, SENT), GROUPS, np.float64)
    return found[:width], found[width:].reshape(width, width)


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix with no negative eigenvalue.

    Sweeps over all pairs of axes, half as many disjoint pairs at a time as there are axes, end when no pair has an entry left beside its two eigenvalues' rounding.
    """
    a, d = matrix.astype(np.float64).copy(), len(matrix)
    v, seats = np.eye(d), np.arange(d + d % 2)
    least = 1e-20 * abs(np.trace(a))
    turned = True
    while turned:
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            p, q = p[(p < d) & (q < d)], q[(p < d) & (q < d)]
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            go = np.abs(off) > np.maximum(1e-16 * np.sqrt(np.abs(dp * dq)), least)
            if not go.any():
                continue
            turned = True
            p, q, off, dp, dq = p[go], q[go], off[go], dp[go], dq[go]
            angle = (dq - dp) / (2 * off)
            t = np.where(angle < 0, -1.0, 1.0) / (np.abs(angle) + np.hypot(angle, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
            a[p, p], a[q, q], a[p, q], a[q, p] = dp - t * off, dq + t * off, 0, 0
            v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order] / np.linalg.norm(v[:, order], axis=0)
    return np.diag(a)[order], v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)


class Whitening:
    """A fitted model: count ``n``, exact sums ``sums``, all ``eigenvalues``, the matrix ``w`` of the components asked for, their ``explained`` shares, and ``identity_error``."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([s % n for s in sums], np.float64) / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S)^2, exact, or null where that is no long. Longs wrap, so the low 64 bits are right in any case, and an estimate tells whether they are all."""
        wrap = (1 << 64) - 1
        own = x.astype(np.uint64) * np.uint64(self.n) - np.array([s & wrap for s in self.sums], np.uint64)
        exact = (own * own).sum(1).view(np.int64)
        about = ((self.centred(x) * float(self.n)) ** 2).sum(1)
        fits = about < 9.2e18
        for i in np.flatnonzero(~fits & (about < 9.25e18)):
            fits[i] = sum((self.n * int(c) - s) ** 2 for c, s in zip(x[i], self.sums, strict=True)) < 1 << 63
        return pa.array(exact, pa.int64(), mask=~fits)


def fit(rows: DataFrame, vector: str, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The model of ``usable`` rows with vectors of ``d`` entries; None if there are no rows or no entries. ``d`` squared numbers fit into a task and the driver."""
    n, sums = totals(rows, vector, d)
    if not n:
        return None
    model = Whitening(n, sums)
    off, scatter = moments(rows, vector, d, d, model.centred)
    covariance = scatter / n - np.outer(off / n, off / n)
    values, vectors = jacobi(covariance)
    k = min(components, d)
    live = values[:k] > NOISE * d * max(values[0], 0)
    model.eigenvalues, model.w = values, np.where(live, vectors[:, :k] / np.sqrt(np.where(live, values[:k], 1)), 0.0)
    model.explained = np.where(live, values[:k], 0) / max(np.trace(covariance), np.finfo(float).tiny)
    off, products = moments(rows, vector, d, k, lambda x: model.centred(x) @ model.w)
    spread = products / n - np.outer(off / n, off / n) - np.diag(live.astype(float))
    model.identity_error = float(np.abs(spread).max())
    return model


def whiten(rows: DataFrame, model: Whitening, vector: str, d: int) -> DataFrame:
    """``rows`` (as from ``usable``) without ``vector`` but with deviation (long) and whitened (array<double>, a number a component), which replace columns of these names."""
    known, names = rows.sparkSession.sparkContext.broadcast(model), ["deviation", "whitened"]  # d times the components, and d sums
    kept = [f for f in rows.drop(vector).schema if f.name not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "deviation bigint, whitened array<double>"])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            keep = [i for i, f in enumerate(batch.schema.names) if f != vector and f not in names]
            for i, j, x in _whole(column, d):
                z = known.value.centred(x) @ known.value.w
                ends = pa.array(np.arange(j - i + 1) * z.shape[1], pa.int32())
                own = [known.value.deviation(x), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), *own], [*(batch.schema.names[c] for c in keep), *names])

    return rows.mapInArrow(run, schema)


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``rows`` without ``vector``, a row a component: component (from 1), n, deviation, whitened, explained and identity_error, which replace columns of these names.

    Left out are rows whose vector is null, has null, non-finite or huge (``LARGEST``) entries, or isn't of the commonest length. Repeated rows count and stay as often as they
    come; null ids and other columns pass through; equal eigenvalues are numbered in the order of the axes. A component without variance (all vectors alike in it, as with one row)
    has 0 for whitened and explained and no part in identity_error; ``deviation`` is null where it is no long. Without rows, or with empty vectors only, the result is empty.
    """
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    some, d = usable(rows.select(*[f"`{c}`" for c in rows.columns if c == vector or c not in names]), vector)
    model = fit(some, vector, d, components) if d else None
    if model is None:
        return some.drop(vector).limit(0).selectExpr("*", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    share = F.array(*[F.lit(float(e)) for e in model.explained])
    made = whiten(some, model, vector, d).withColumns({"n": F.lit(model.n).cast("long"), "identity_error": F.lit(model.identity_error)})
    return made.select("*", F.posexplode("whitened").alias("__at", "__value")).select(
        *[f"`{c}`" for c in some.columns if c != vector], (F.col("__at") + 1).alias("component"), "n", "deviation", F.col("__value").alias("whitened"), share[F.col("__at")].alias("explained"), "identity_error"
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
