"""Connected components of an edge table, by contraction; only whether edges are left reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def lowest(edges: DataFrame) -> DataFrame:
    """(node, to): for each node of ``edges`` (columns a, b) that of it and its neighbours with the smallest hash, as a written table. Minima have map-side halves, so a hub's edges needn't meet."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
    own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v"))
    return written(found.select("node", F.least("m", own)["v"].alias("to")), "lowest")


def moved(rows: DataFrame, low: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` taken to where ``low`` sends it. ``low`` is a written table, so Spark may split the rows of a hub at the join."""
    to = low.select(F.col("node").alias(column), F.col("to").alias("__to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (columns a, b: long) the smallest node that it reaches. Self-loops and repeats do no harm; no edges give an empty table.

    Each round sends every node to its lowest neighbour in the order of a hash, so chains of any numbering shrink by a share of their nodes, and the edges between what is left go on.
    """
    e = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        rounds.append(lowest(e))
        to = moved(moved(e, rounds[-1], "a"), rounds[-1], "b").filter("a <> b")
        e = written(to.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not rounds:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].withColumnRenamed("to", "root")
    for low in rounds[1:]:
        out = moved(out, low, "root")
    out = written(out, "labels")
    least = written(out.groupBy("root").agg(F.min("node").alias("least")), "least")
    return out.join(least, "root").select("node", F.col("least").alias("root"))
