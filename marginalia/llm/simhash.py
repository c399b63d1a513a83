"""Operator 7: SimHash fingerprints and exact search within a Hamming radius, with DataFrame functions only.

Every term (a word with the word before it) votes on 64 signed bits with the bits of its hash; longer words weigh more, and a term votes as
often as it occurs. Votes are added four counters to a long, so that one term costs sixteen additions in generated code.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, let, words_of, written

BITS = 64
#: Terms a piece: four counters of 15 bits fit a signed long, at weights up to 4.
PIECE = 8191
#: Every 16th bit: the four counters of a long.
LANES = 0x0001000100010001
#: Rows that a window's range of ids should hold, and the ranges up to which that is so; beyond, ranges grow in number and in rows alike.
RANGE_ROWS, MANY_RANGES = 1000, 1 << 14
#: Bits in which near fingerprints may differ.
RADIUS = 3


def term_codes(text: Column) -> Column:
    """Each term's hash, with its weight less one (0 to 3, by the word's length) in the lowest two bits."""
    weight = lambda w: F.least(F.lit(3), F.floor(F.length(w) / 3)).cast("long")
    code = lambda ws: F.transform(ws, lambda w, i: F.shiftleft(F.xxhash64(w, F.get(ws, i - 1)), 2).bitwiseOR(weight(w)))
    return let(words_of(text), code)


def fingerprints(rows: DataFrame, by: list[str], text: str, into: str = "fp") -> DataFrame:
    """One row for each ``by`` key with the fingerprint (long) of its text; ``by`` must be unique. Texts without words get 0; equal texts get equal fingerprints.

    Terms are added up inside the task that holds the text. Texts of any length do: counters are carried over by pieces of ``PIECE`` terms.
    """
    terms = rows.select(*by, F.posexplode_outer(term_codes(F.col(text))).alias("__pos", "__code"))
    terms = terms.select(*by, F.floor(F.coalesce("__pos", F.lit(0)) / PIECE).alias("__piece"), F.xxhash64("__code").alias("__h"), F.when(F.col("__code").isNull(), F.lit(0)).otherwise(F.col("__code").bitwiseAND(3) + 1).alias("__w"))
    lane = lambda k: F.shiftrightunsigned("__h", k).bitwiseAND(F.lit(LANES)) * F.col("__w")
    pieces = terms.groupBy(*by, "__piece").agg(F.sum("__w").alias("__w"), *[F.sum(lane(k)).alias(f"__l{k}") for k in range(16)])
    votes = {f"__b{k + 16 * j}": F.shiftrightunsigned(f"__l{k}", 16 * j).bitwiseAND(0xFFFF) for j in range(4) for k in range(16)}
    sums = pieces.select(*by, "__w", *[v.alias(k) for k, v in votes.items()]).groupBy(*by).agg(F.sum("__w").alias("__w"), *[F.sum(k).alias(k) for k in votes])
    bits = [F.when(2 * F.col(f"__b{b}") > F.col("__w"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(BITS)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return sums.select(*by, bits[0].cast("long").alias(into))


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of bits that differ."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_keys(fp: Column, radius: int) -> list[tuple[int, list[int], Column]]:
    """The permuted block tables for a radius: for each choice of blocks that two fingerprints within it may share, (number, blocks, key).

    With radius + 3 blocks, fingerprints within the radius agree on at least three, so each choice of three blocks is a table, keyed by those blocks.
    """
    n = radius + 3
    edges = [BITS * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [(t, list(c), fp.bitwiseAND(F.lit(signed(sum(masks[i] for i in c))))) for t, c in enumerate(combinations(range(n), 3))]


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(query_fp, fp, distance): for each distinct fingerprint in ``queries``, every distinct one in ``prints`` (column fp) within ``radius`` bits.

    Exact: all block tables are searched, and a pair is given by the first table that finds it. Nulls match nothing; equal ones give distance 0.
    """
    n = radius + 3
    edges = [BITS * i // n for i in range(n + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [F.lit(signed(((1 << (b - a)) - 1) << a)) for a, b in zip(edges, edges[1:], strict=False)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(sum(1 << i for i in c)).alias("c"), F.lit((1 << c[-1]) - 1).alias("low"), k.alias("k")) for t, c, k in block_keys(F.col("fp"), radius)])
        return df.select("fp").filter("fp is not null").distinct().select(F.col("fp").alias(name), F.inline(keys))

    x = F.col("query_fp").bitwiseXOR(F.col("fp"))
    same = F.lit(0)
    for i, m in enumerate(masks):
        same = same + F.when(x.bitwiseAND(m) == 0, F.lit(1 << i)).otherwise(F.lit(0))
    first = same.bitwiseAND(F.col("low")).bitwiseAND(F.bitwise_not(F.col("c"))) == 0
    q, p = tables(queries, "query_fp"), tables(prints, "fp").drop("c", "low")
    return q.join(p, ["t", "k"]).filter((F.bit_count(x) <= radius) & first).select("query_fp", "fp", F.bit_count(x).alias("distance"))


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Each row with the next row's text, by descending id, after the last the first: (__range, __at, __ghost, id, text, next_text).

    Rows are dealt once, by ranges of ids at sampled quantiles that are ids themselves. The row at the top of a range is the one that follows the
    range above, so it is dealt there too, as a ghost that ends that range; no range is needed elsewhere. Ties on the id are put in order by the text;
    null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    n = docs.count()
    wanted = -(-n // RANGE_ROWS)
    k = ranges or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(wanted, MANY_RANGES + math.isqrt(wanted)))
    at = F.expr(f"percentile_approx(__id, array({', '.join(f'{(i + 1) / k!r}D' for i in range(k))}), {10 * k})")
    bounds = rows.agg(F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce(at, F.array().cast("array<bigint>")), F.array(F.max("__id")))))).alias("b")).scalar()
    rows = rows.withColumn("__b", bounds)
    steps = F.array(*[F.lit(1 << j) for j in range(k.bit_length(), -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda s, p: s + F.when(F.coalesce(F.get("__b", s + p - 1) < F.col("__id"), F.lit(False)), p).otherwise(F.lit(0)))
    rows = rows.withColumn("__range", F.when(F.col("__id").isNull(), F.lit(0)).otherwise(below))
    top = F.coalesce(F.get("__b", F.col("__range")) == F.col("__id"), F.lit(False))
    above = F.when(F.col("__range") + 1 < F.size("__b"), F.col("__range") + 1).otherwise(F.lit(0))
    own = lambda r, ghost: F.struct(r.alias("__range"), F.lit(ghost).alias("__ghost"))
    dealt = rows.withColumn("__places", F.when(top, F.array(own(F.col("__range"), False), own(above, True))).otherwise(F.array(own(F.col("__range"), False))))
    dealt = dealt.drop("__range", "__b").select("__id", "__text", F.inline("__places"))
    order = Window.partitionBy("__range").orderBy("__ghost", F.col("__id").desc_nulls_last(), "__text")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("__text").over(order), F.when(F.col("__id").isNull(), F.first("__text").over(whole)), F.lit(""))
    return dealt.select("__range", F.row_number().over(order).alias("__at"), "__ghost", F.col("__id").alias(id), F.col("__text").alias(text), after.alias("next_text"))


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Nulls count as empty texts; repeated rows stay apart, ties on the id are put in order by text; a lone row follows itself; an empty table gives an empty result; other columns aren't kept."""
    pairs = with_next(docs, id, text, ranges)
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    both = pairs.select("__range", "__at", "__ghost", id, n.cast("long").alias("n_chars"), text, edited.alias("__edited"))
    both = both.withColumn("__sha", F.sha2("__edited", 256))
    keys = ["__range", "__at", "__ghost", id, "n_chars", "__sha"]
    versions = both.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col(text).alias("t")), F.struct(F.lit(1).alias("v"), F.col("__edited").alias("t")))).alias("__v"))
    prints = fingerprints(versions.select(*keys, "__v.v", "__v.t"), [*keys, "v"], "t")
    rows = prints.groupBy(*keys).agg(F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("__own"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("__new"))
    order = Window.partitionBy("__range").orderBy("__at")
    first = F.first("__own").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("__next", F.coalesce(F.lead("__own").over(order), first)).filter("not __ghost")
    return rows.select(
        id, "n_chars", F.col("__sha").alias("edited_sha256"), hex_of(F.col("__own")).alias("fingerprint"), hex_of(F.col("__new")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__new")).alias("near_edited"), likeness(F.col("__own"), F.col("__next")).alias("near_next"),
    )


def near_counts(prints: DataFrame, queries: Column, radius: int = RADIUS, id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``prints`` (id, fp, ...) with ``n_near``: for rows that ``queries`` picks, how many other rows have a fingerprint within ``radius`` bits, by the block tables; null for others.

    Distinct fingerprints are searched, so copies cost nothing; their rows are counted. Repeated ids each count as a row. A null fingerprint has none near.
    """
    fps = written(prints.groupBy(F.col(fp).alias("fp")).agg(F.count("*").alias("rows")), "prints")
    asked = prints.filter(queries).select(F.col(fp).alias("fp")).distinct()
    found = within_radius(fps, asked, radius).join(fps, "fp").groupBy("query_fp").agg((F.sum("rows") - 1).alias("__near"))
    out = prints.withColumn("__fp", F.when(queries, F.col(fp))).join(written(found, "near"), F.col("__fp") == F.col("query_fp"), "left")
    return out.withColumn("n_near", F.when(queries, F.coalesce("__near", F.lit(0)))).drop("__fp", "__near", "query_fp")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprints; ``n_near``, for each document whose id is divisible by 20, counts the documents near it among all."""
    rows = written(edited_fingerprints(documents(spark, sf_dir).select("doc_id", "text")), "fingerprints")
    fp = F.conv(F.col("fingerprint"), 16, -10).cast("long")
    return near_counts(rows.withColumn("fp", fp), F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))).drop("fp")
