"""Exact nearest ranks of groups of any size: splitting passes narrow each rank down to a few values, so no task holds a group's values."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a pass; distinct numbers that are windowed at once. Beyond 2**53 this many whole numbers at least share a double, which splitters are.
BUCKETS, LEAF = 64, 4096


def nearest_ranks(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column a share): of each group's numbers, without nulls, the smallest that at least that share of them don't exceed. NaN is the largest number. Groups of nulls only have none.

    Equal numbers are counted before they are moved. A pass cuts the distinct numbers that a rank may be into ``BUCKETS`` of about as many, by approximate quantiles, adds up the counts of each
    bucket, and goes on in the bucket that has the rank; once there are no more than ``LEAF``, these are windowed. So passes grow with the logarithm of a group's distinct numbers.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    whole = counts.groupBy("k").agg(F.sum("n").alias("all"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("distinct"))
    asked = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.greatest(F.lit(1), F.ceil(F.round(F.col("all") * q, 9))).cast("bigint").alias("rank")) for s, q in shares.items()]))
    state = whole.select("k", asked.alias("a"), "lo", "hi", "distinct").select("k", "a.share", "a.rank", "lo", "hi", "distinct").persist(StorageLevel.DISK_ONLY)
    keys, done = ["k", "share", "rank"], None
    past = lambda by: F.coalesce(F.sum("n").over(Window.partitionBy("k", "share").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    holds = (F.col("past") < F.col("rank")) & (F.col("rank") <= F.col("past") + F.col("n"))
    while True:
        leaf = _within(counts, state.filter(F.col("distinct") <= LEAF)).withColumn("past", past("v")).filter(holds).select("k", "share", "v")
        done = leaf if done is None else done.unionByName(leaf)
        wide = state.filter(F.col("distinct") > LEAF)
        if wide.isEmpty():
            return done.groupBy("k").pivot("share", list(shares)).agg(F.first("v")).withColumnRenamed("k", key)
        met = _within(counts, wide)
        x = F.col("v").cast("double")
        finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
        cuts = met.filter(finite).groupBy(*keys).agg(F.percentile_approx(x, [k / BUCKETS for k in range(1, BUCKETS)], 1000).alias("cuts"))
        cuts = cuts.withColumnsRenamed({c: f"__{c}" for c in keys})
        met = met.join(cuts, F.col("k").eqNullSafe(F.col("__k")) & (F.col("share") == F.col("__share")))
        bucket = F.when(finite, F.size(F.filter("cuts", lambda c: c < x))).when(F.isnan(x), BUCKETS + 1).when(x > 0, BUCKETS).otherwise(-1)
        hist = met.groupBy(*keys, bucket.alias("b")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("distinct"))
        hist = hist.withColumn("past", past("b")).filter(holds)
        state = hist.select("k", "share", (F.col("rank") - F.col("past")).alias("rank"), "lo", "hi", "distinct").persist(StorageLevel.DISK_ONLY)


def _within(counts: DataFrame, state: DataFrame) -> DataFrame:
    """The counted numbers within the bounds of each rank."""
    s = state.withColumnRenamed("k", "__k")
    return counts.join(s, F.col("k").eqNullSafe(F.col("__k")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("__k", "lo", "hi", "distinct")
