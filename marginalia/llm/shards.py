"""Training shards: rows dealt to numbered shards by a hash of themselves, so that a model is the same on any cluster, and sums of the shards' arrays in a tree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import by_key

#: Pieces of an array that are added up side by side.
PARTS = 16
#: Most partitions that shards are dealt to; a partition may hold several shards, one after another.
MOST_PARTITIONS = 8192
SENT = "shard bigint, part bigint, x binary"


def dealt(rows: DataFrame, shards: int, shard: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``shard``, each shard whole and in order inside one partition."""
    k = min(shards, MOST_PARTITIONS)
    return rows.withColumn("shard", shard.cast("bigint")).repartitionById(k, F.pmod("shard", F.lit(k)).cast("int")).sortWithinPartitions("shard", *order)


def sent(shard: int, x: np.ndarray, kind=np.float32) -> pa.RecordBatch:
    """A shard's array in ``PARTS`` pieces, of single precision if nothing else is asked for."""
    parts = [p.astype(kind).tobytes() for p in np.array_split(x, PARTS)]
    return pa.RecordBatch.from_arrays([pa.array([shard] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int64()), pa.array(parts, pa.binary())], ["shard", "part", "x"])


def summed(made: DataFrame, shards: int, kind=np.float32) -> np.ndarray | None:
    """The sum of the shards' arrays (rows of ``sent``, of the same ``kind``), or None without any. Pieces are added first in groups of about the root of the number of shards, then the groups, always in order."""
    groups = max(1, math.isqrt(shards))

    def add(kind):
        def run(batches):
            for key, own in by_key(batches, "key"):
                total = None
                for batch in own:
                    for x in batch.column("x"):
                        x = np.frombuffer(x.as_buffer(), kind)
                        total = x.astype(np.float64) if total is None else total + x
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["key", "x"])

        return run

    first = made.withColumn("key", F.col("part") * groups + F.col("shard") % groups).repartition("key").sortWithinPartitions("key", "shard").select("key", "x")
    mid = first.mapInArrow(add(kind), "key bigint, x binary")
    last = mid.select(F.expr(f"key div {groups}").alias("key"), F.col("key").alias("g"), "x").repartition("key").sortWithinPartitions("key", "g").select("key", "x")
    found = sorted(last.mapInArrow(add(np.float64), "key bigint, x binary").collect(), key=lambda r: r.key)  # one array of a fixed size
    return np.concatenate([np.frombuffer(r.x, np.float64) for r in found]) if found else None
