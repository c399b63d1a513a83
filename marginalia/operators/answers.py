"""Whole answers from the look-ups: relations with fragments and stages, or what stands for them; evidence in order and cut to its intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import bounded, stages
from .retrieval import TOP_PARENTS

# The type of a relation that only excerpts speak for; the mark of an exact hit's reason; how many pieces of evidence an intent keeps (others keep all), and a reader's style.
UNCONFIRMED, EXACT = "检索证据/待确认", "原文精确命中"
KEPT = {"entity_timeline": 3, "first_appearance": 1, "theme_explore": TOP_PARENTS, "compare": TOP_PARENTS, "causal": TOP_PARENTS, "semantic_search": TOP_PARENTS}
STYLES = {"brief": 1, "简洁": 1, "detailed": TOP_PARENTS, "详细": TOP_PARENTS}
PAIR = ["book_id", "source", "target"]


def _first(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """(keys, fragments): the first ``most`` (chapter_number, excerpt) of each group, in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    listed = F.array_sort(F.collect_list(F.struct("__r", "chapter_number", "excerpt")))
    cut = rows.withColumn("__r", place).filter(F.col("__r") <= most).groupBy(*keys).agg(listed.alias("x"))
    return cut.select(*keys, F.transform("x", lambda f: F.struct(f["chapter_number"].alias("chapter_number"), f["excerpt"].alias("excerpt"))).alias("fragments"))


def _answered(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """(keys, first_chapter_number, mention_count, fragments, stages) of fragments (keys, chapter_number, excerpt)."""
    counts = rows.groupBy(*keys).agg(F.min("chapter_number").alias("first_chapter_number"), F.count("*").alias("mention_count"))
    parts = F.array_sort(F.collect_list(F.struct("stage", "chapter_start", "chapter_end", "excerpt_count")))
    staged = stages(rows, keys).groupBy(*keys).agg(parts.alias("stages"))  # three at most
    return counts.join(_first(rows, keys, order, most), keys).join(staged, keys)


def relation_answers(pairs: DataFrame, mentions: DataFrame, asked: DataFrame, max_chapter: int | None = None, reach: int = 220, most: int = 3) -> DataFrame:
    """``PAIR``, relation_type, first_chapter_number, mention_count, fragments, stages: what is known of the ``asked`` pairs (source, target), either way round, up to a chapter.

    A pair with typed relations (``mentions.relations``) in a book has one row a type. One without has one row of the type ``UNCONFIRMED`` if mentions of both are within ``reach`` characters of one chapter:
    its fragments are each mention of the source with the target's first one there, ``most`` at most, and count as its mentions. A pair without either has none.
    """
    both = asked.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), F.col("source").alias("__a"), F.col("target").alias("__b")).dropDuplicates(["source", "target"])
    typed = bounded(pairs, max_chapter).join(F.broadcast(both.select("source", "target")), ["source", "target"]).withColumn("excerpt", F.col("sentence"))  # questions
    keys = [*PAIR, "relation_type"]
    known = _answered(typed, keys, ["chapter_number", "window_no", "excerpt"], most).select(*keys, "first_chapter_number", "mention_count", "fragments", "stages")
    seen = bounded(mentions, max_chapter)
    at = lambda c, a: seen.join(F.broadcast(both.select(F.col(c).alias("name"), "source", "target", "__b")), "name").select("book_id", "source", "target", "__b", "chapter_number", F.col("position").alias(f"{a}p"), F.col("excerpt").alias(f"{a}e"))
    left, right = at("__a", "l"), at("__b", "r").drop("__b")
    near = left.join(right, [*PAIR, "chapter_number"]).filter(F.abs(F.col("lp") - F.col("rp")) <= reach)
    near = near.groupBy(*PAIR, "__b", "chapter_number", "lp", "le").agg(F.min_by("re", "rp").alias("re"))
    near = near.withColumn("excerpt", F.when(F.contains("le", F.col("__b")), F.col("le")).otherwise(F.col("re"))).join(known.select(*PAIR).distinct(), PAIR, "left_anti")
    place = F.row_number().over(Window.partitionBy(*PAIR).orderBy("chapter_number", "lp"))
    near = near.withColumn("__n", place).filter(F.col("__n") <= most)
    guessed = _answered(near, PAIR, ["chapter_number", "lp"], most).withColumn("relation_type", F.lit(UNCONFIRMED))
    return known.unionByName(guessed.select(*known.columns))


def ordered_evidence(evidence: DataFrame, key: str = "query_id") -> DataFrame:
    """Adds ``rank`` to (``key``, seq, reason): a question's exact hits first, else in the order in which evidence came (``seq``)."""
    return evidence.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(~F.startswith("reason", F.lit(EXACT)), "seq")))


def kept_evidence(evidence: DataFrame) -> DataFrame:
    """Of ``ordered_evidence`` with intent and answer_style (null: none), what each question's intent keeps, and of that what its reader's style does."""
    most = lambda c, table: F.coalesce(F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in table.items()]), lambda x: x["k"] == c), 0)["n"], F.lit(2**31 - 1))
    return evidence.filter(F.col("rank") <= F.least(most(F.col("intent"), KEPT), most(F.lower(F.btrim("answer_style")), STYLES)))


def split_list(text: Column) -> Column:
    """The parts of a list joined by ``、``, without empty ones; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "、"), lambda x: x != "")


def stamp(at: Column) -> Column:
    """A moment as ``2024-01-31 09:05`` in the session's time zone, and as ``20240131-090500`` for names of files."""
    return F.struct(F.date_format(at, "yyyy-MM-dd HH:mm").alias("shown"), F.date_format(at, "yyyyMMdd-HHmmss").alias("name"))
