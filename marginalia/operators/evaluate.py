"""Evaluation of retrieval: Top1, Recall@K, MRR, coverage, nearest-rank percentiles, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import case_folded, let
from .selection import nearest_ranks


def case_results(cases: DataFrame, hits: DataFrame, top_k: int = 4) -> DataFrame:
    """One row a method and case: first relevant rank, reciprocal rank, recall and top1.

    ``cases``: case_id, relevant (array<int>); ``hits``: method, case_id, rank, chapter_number. A case without hits counts as missed.
    """
    methods = hits.select("method").distinct()
    top = hits.filter(F.col("rank") <= top_k)
    rows = cases.join(F.broadcast(methods)).join(top, ["method", "case_id"], "left")
    ok = F.coalesce(F.array_contains("relevant", F.col("chapter_number")), F.lit(False))
    found = rows.groupBy("method", "case_id").agg(
        F.min(F.when(ok, F.col("rank"))).alias("first_rank"), F.countDistinct(F.when(ok, F.col("chapter_number"))).alias("found"),
        F.max(F.size(F.array_distinct("relevant"))).alias("wanted"), F.coalesce(F.max(ok & (F.col("rank") == 1)), F.lit(False)).alias("top1"),
    )
    return found.select("method", "case_id", "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("found") / F.col("wanted")).alias("recall"), "top1")


def report(results: DataFrame) -> DataFrame:
    """Means a method. ``coverage`` (if there) averages the cases that have terms; ``error`` (text, null without one) and ``violations`` (if there) are counted, and a case with an error counts as zeros."""
    cols = [F.count("*").alias("total_cases"), F.avg(F.col("top1").cast("double")).alias("top1_accuracy"), F.avg("recall").alias("recall_at_k"), F.avg("reciprocal_rank").alias("mrr")]
    if "coverage" in results.columns:
        cols.append(F.avg("coverage").alias("term_coverage"))
    if "error" in results.columns:
        cols.append(F.count("error").alias("errors"))
    if "violations" in results.columns:
        cols.append(F.sum(F.coalesce("violations", F.lit(0))).alias("violations"))
    return results.groupBy("method").agg(*cols)


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank p50 and p95, for groups of any size."""
    return nearest_ranks(rows, key, value, {"p50": 0.5, "p95": 0.95})


def coverage(cases: DataFrame, hits: DataFrame, top_k: int = 4) -> DataFrame:
    """(method, case_id, coverage): the share of a case's evidence terms (``evidence_terms``) that one of its first hits' texts (``text``) has, by Unicode's full folding of case: ß is ss, and both Greek sigmas are one. Cases without terms have null.

    Terms count once, blanks around them aside; empty ones don't count. A case without hits has 0.
    """
    asked = cases.select("case_id", F.array_distinct(F.filter(F.transform("evidence_terms", lambda x: F.btrim(x)), lambda x: x != "")).alias("terms"))
    rows = asked.join(F.broadcast(hits.select("method").distinct())).join(hits.filter(F.col("rank") <= top_k).select("method", "case_id", "text"), ["method", "case_id"], "left")
    folded = case_folded(F.coalesce("text", F.lit("")))
    held = rows.select("method", "case_id", "terms", let(folded, lambda t: F.filter("terms", lambda x: F.contains(t, case_folded(x)))).alias("held"))
    found = held.groupBy("method", "case_id").agg(F.max(F.size("terms")).alias("wanted"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("found"))
    return found.select("method", "case_id", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).alias("coverage"))


def violations(cases: DataFrame, hits: DataFrame, top_k: int = 4) -> DataFrame:
    """(method, case_id, violations): hits beyond a case's ``max_chapter`` (null: no bound), which a bounded search never gives."""
    met = hits.filter(F.col("rank") <= top_k).join(cases.select("case_id", "max_chapter"), "case_id")
    return met.groupBy("method", "case_id").agg(F.count_if(F.col("chapter_number") > F.col("max_chapter")).alias("violations"))


def rendered(reports: DataFrame) -> DataFrame:
    """(method, line): each report as a line of text, shares as percentages."""
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    parts = [F.concat(F.col("method"), F.lit("："), F.col("total_cases").cast("string"), F.lit(" 题")), F.concat(F.lit("Top1 "), percent("top1_accuracy")), F.concat(F.lit("Recall@K "), percent("recall_at_k")), F.concat(F.lit("MRR "), F.format_string("%.3f", F.col("mrr")))]
    for c, label in (("term_coverage", "证据词 "), ("errors", "错误 "), ("violations", "越界 ")):
        if c in reports.columns:
            parts.append(F.concat(F.lit(label), percent(c) if c == "term_coverage" else F.col(c).cast("string")))
    return reports.select("method", F.concat_ws("，", *parts).alias("line"))


def gate(reports: DataFrame, min_top1: float, min_mrr: float) -> DataFrame:
    """(method, failure) for each threshold that a method misses."""
    fails = F.array_compact(F.array(F.when(F.col("top1_accuracy") < min_top1, "top1"), F.when(F.col("mrr") < min_mrr, "mrr")))
    return reports.select("method", F.explode(fails).alias("failure"))
