"""Operator 6: quality rules by a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Two multinomials over hashed n-grams are counted: one over a trusted target, one over the whole raw corpus. A document's score is the
mean log ratio of its n-grams; a fixed threshold decides each document. The n-grams are words, and each two words that follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, let, spaced, split_words, words_of

#: Size of the hashed n-gram space; the table of ratios is that many doubles, whatever the corpus.
BUCKETS = 1 << 16
#: Bound of the trusted sample (labelled rows with quality 1, by the hash of their id).
TRUSTED_ROWS = 20_000
#: Kept: mean log ratio of at least this.
THRESHOLD = -0.1
#: Pseudo-count of each bucket.
SMOOTHING = 0.5
#: Columns that the rules add, in place of columns of these names.
RESULT = ("n_words", "word_chars", "n_repeat_words", "llr", "n_symbols", "n_dup_lines", "base_failed", "kept")


def _repeat_words(h: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, from the words' hashes."""

    def of_keys(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), of_sorted)
        )

    def of_sorted(s: Column) -> Column:
        near = lambda x, j: F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))
        found = F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - p, F.lit(5))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])
    return F.when(F.size(h) < 6, F.lit(0)).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(h) - 5), window), of_keys))


def _grams(hashes: Column) -> Column:
    """The hashed n-grams of a text from its words' hashes: the words, and each two that follow each other."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.transform(hashes, lambda h, i: bucket(F.xxhash64(h, F.get(hashes, i + 1))))
    return F.concat(F.transform(hashes, bucket), F.slice(pairs, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))))


def ngram_buckets(text: Column) -> Column:
    return let(words_of(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), _grams))


def _counts(text: Column, ratios: Column) -> Column:
    """n_words, word_chars, n_repeat_words and llr of a text, as a struct; its words are split and hashed once."""

    def of_words(t: Column, w: Column, h: Column) -> Column:
        llr = let(_grams(h), lambda g: F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(ratios, b)) / F.size(g))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(t) - F.size(F.split(t, " ")) + 1).cast("long").alias("word_chars"),
            _repeat_words(h).cast("long").alias("n_repeat_words"),
            F.when(F.size(w) == 0, F.lit(0.0)).otherwise(llr).alias("llr"),
        )

    return let(spaced(text), lambda t: let(split_words(t), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: of_words(t, w, h))))


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    worded = lambda x: F.filter(x, lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    more = lambda x: let(worded(x), lambda y: F.size(y) - F.size(F.array_distinct(y)))
    return let(F.split(text, "\n"), lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(more(x)))


def fit_ratios(docs: DataFrame, trusted_ids: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (``ratios`` array<double>, by bucket): the log of smoothed target over corpus frequency of each hashed n-gram.

    ``trusted_ids``: ids of the trusted target, of a bounded number; if it has no words, there is nothing to compare with, and all ratios are 0. The corpus counts cover all rows; each task sends one row a bucket at most.
    """
    spark = docs.sparkSession
    flags = trusted_ids.select(F.col(id).alias("__trusted")).distinct()
    rows = docs.select(id, text).join(F.broadcast(flags), F.col(id) == F.col("__trusted"), "left")
    grams = rows.select(F.col("__trusted").isNotNull().cast("long").alias("t"), F.explode(ngram_buckets(F.col(text))).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("m"))
    full = spark.range(0, BUCKETS, 1, 1).join(counts, F.col("id") == F.col("b"), "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "m")])
    table = full.agg(F.sort_array(F.collect_list(F.struct("id", "n", "m"))).alias("a"), F.sum("n").alias("n_all"), F.sum("m").alias("m_all"))
    part = lambda x, c: F.log((x[c] + SMOOTHING) / (F.col(f"{c}_all") + SMOOTHING * BUCKETS))
    ratios = F.transform("a", lambda x: F.when(F.col("m_all") == 0, F.lit(0.0)).otherwise(part(x, "m") - part(x, "n")))
    return table.select(ratios.alias("ratios"))


def quality_rules(docs: DataFrame, ratios: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``llr`` (mean log ratio an n-gram; 0 for a text without words) and ``kept``.

    Nulls count as empty texts (base_failed); repeated rows are each decided alike; an empty table gives an empty result; other columns pass
    through, but for those in ``RESULT``, which are replaced. A ratio equal to the threshold is kept.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    counts = let(_counts(F.col(text), F.col("__ratios")), lambda s: F.struct(
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "llr")],
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), _dup_lines(t).cast("long").alias("n_dup_lines"),
    ))
    # A generator stands between the counts and whatever filters on them, so they are made once a row.
    kept = docs.drop(*RESULT).withColumn("__ratios", ratios.scalar())
    out = kept.select("*", F.inline(F.array(counts))).drop("__ratios")
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def trusted(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``rows`` ids labelled quality 1, those with the smallest hashes."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ratios = fit_ratios(docs, trusted(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = quality_rules(docs, ratios)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
