"""Operator 4: shards along a Hilbert curve.

Several metadata columns are quantised at their quantiles, rows are sorted by the index of their cell on a Hilbert curve, and the order is cut
into runs of equal row counts (law ``rows``), so that each shard spans a compact box of the metadata and readers can skip it by its minima and maxima.
"""

from __future__ import annotations

from itertools import product

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, ranked

BITS = 4
SHARDS = 8


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """The place of a grid point on the Hilbert curve (the transpose method of Skilling, 2004)."""
    x, n, top = list(point), len(point), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = 0, top
    while q > 1:
        if x[-1] & q:
            flip ^= q - 1
        q >>= 1
    place = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            place = place << 1 | ((v ^ flip) >> b & 1)
    return place


#: Distinct values that the driver ranks at once, and values that split what is more than these.
LEAF, SPLITS = 4096, 255


def cuts_of(df: DataFrame, dimensions: list[str], cells: int) -> list[list]:
    """For each dimension the values at which its next cell begins: the exact quantiles of all rows, in the values' own order, without nulls and NaN. Rows are read once, and equal ones are counted before anything else."""
    met = df.groupBy(*[F.col(c).alias(f"d{i}") for i, c in enumerate(dimensions)]).agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    out = []
    for i in range(len(dimensions)):
        v = F.col(f"d{i}")
        some = v.isNotNull() & ~F.isnan(v) if met.schema[f"d{i}"].dataType.typeName() in ("float", "double") else v.isNotNull()
        out.append(quantiles(met.filter(some).groupBy(v.alias("v")).agg(F.sum("n").alias("n")), cells))
    met.unpersist()
    return out


def quantiles(counts: DataFrame, cells: int) -> list:
    """The distinct values at ranks k * rows // cells (from 0) of counted values (v, n), for k from 1 to cells - 1.

    While there are more than ``LEAF`` values that may be one of these, some of them split the rest, rows are counted between the splits, and only what lies around a rank stays. The splits only
    say where counting is done, so the result is exact whichever they are; passes grow with the logarithm of the number of distinct values.
    """
    counts = counts.persist(StorageLevel.DISK_ONLY)
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi")).toArrow().to_pylist()[0]
    found, live = set(), []
    if whole["n"]:
        live = [(whole["lo"], whole["hi"], 0, whole["distinct"], sorted({k * whole["n"] // cells for k in range(1, cells)}))]
    while live:
        piece = F.lit(None).cast("int")
        for k, (lo, hi, *_) in enumerate(live):
            piece = F.when(F.col("v").between(F.lit(lo), F.lit(hi)), k).otherwise(piece)
        rows = counts.withColumn("piece", piece).filter(F.col("piece").isNotNull())
        if sum(x[3] for x in live) <= LEAF:
            pieces = [{**r, "lo": r["v"], "hi": r["v"], "distinct": 1} for r in rows.toArrow().to_pylist()]
        else:
            splits = sorted(rows.orderBy(F.xxhash64("v"), "v").limit(SPLITS).select("v").toArrow()["v"].to_pylist())
            at = F.array(*[F.lit(x) for x in splits])
            cut = rows.withColumn("b", F.size(F.filter(at, lambda x: x <= F.col("v"))))
            pieces = cut.groupBy("piece", "b").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi")).toArrow().to_pylist()
        more = []
        for k, (_, _, past, _, ranks) in enumerate(live):
            for p in sorted((p for p in pieces if p["piece"] == k), key=lambda p: p["lo"]):
                own = [r for r in ranks if past <= r < past + p["n"]]
                if own and p["distinct"] == 1:
                    found.add(p["lo"])
                elif own:
                    more.append((p["lo"], p["hi"], past, p["distinct"], own))
                past += p["n"]
        live = more
    counts.unpersist()
    return sorted(found)


def curve(df: DataFrame, dimensions: list[str], bits: int = BITS) -> Column:
    """The curve index of a row's cell, of 2**bits a dimension at most. Values are compared whole, strings by their bytes; nulls are in the first cell."""
    cells, place = 1 << bits, F.lit(0)
    for c, cuts in zip(dimensions, cuts_of(df, dimensions, cells), strict=True):
        cell = F.lit(0)
        for cut in cuts:
            cell = cell + F.coalesce(F.col(c) >= F.lit(cut), F.lit(False)).cast("int")
        place = place * cells + cell
    table = F.expr(f"array({', '.join(str(hilbert_index(p, bits)) for p in product(range(cells), repeat=len(dimensions)))})")
    return F.element_at(table, place + 1)


def hilbert_shards(df: DataFrame, dimensions: list[str], order: list[Column], shards: int = SHARDS, bits: int = BITS, spread: int = 256) -> DataFrame:
    """``df`` with ``curve`` (int), ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard); shard sizes differ by one row at most.

    Inside a cell rows follow a hash of ``order``. Nulls in a dimension are in its first cell; ties and repeated rows get different slots; long values are compared whole;
    an empty table stays empty; columns named curve, shard or slot are replaced.
    """
    placed = df.withColumn("curve", curve(df, dimensions, bits))
    cells = placed.groupBy("curve").agg(F.count("*").alias("__n"))  # one row a cell: 2**(bits * dimensions) at most
    w = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    rows = ranked(placed, ["curve"], order, "__rank", spread).join(F.broadcast(cells), "curve")
    rank = F.col("__start") + F.col("__rank")
    rows = rows.withColumn("shard", F.expr(f"({shards} * (__start + __rank + 1) + __all - 1) div __all - 1").cast("int"))
    return rows.withColumn("slot", (rank - F.expr(f"(shard * __all) div {shards}")).cast("long")).drop("__start", "__rank", "__all")


def write_shards(sharded: DataFrame, path: str, files: int = 64) -> None:
    """One folder a shard, of Parquet files that are runs of the curve: ranges of (shard, slot), so that a shard is written by many tasks."""
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = hilbert_shards(rows, ["source", "lang", "size"], [F.col("doc_id"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
