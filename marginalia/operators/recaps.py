"""Summaries of chapters by a model, and recaps of stages of successive chapters, joined back to the chapter that closes the stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ingest import running
from .payloads import SUMMARY, complete, rendered_summary, tolerant

#: Chapters of a stage at least and at most; characters of a recap.
STAGE, RECAP = (2, 20), 240


def chapter_summaries(answers: DataFrame, payload: str = "answer") -> DataFrame:
    """``answers`` (a chapter's keys, and a model's answer) with ``summary``, the rendered payload; chapters without one, as where the model failed, are left out."""
    out = answers.withColumn("summary", rendered_summary(tolerant(F.col(payload), SUMMARY))).drop(payload)
    return out.filter("summary <> ''")


def staged(chapters: DataFrame, size: int = 10) -> DataFrame:
    """Adds stage (from 0), opens and closes: windows of ``size`` chapters (clamped to ``STAGE``) of a book in order. Places are counted block by block (``ingest.running``), so a book isn't one task."""
    size = max(STAGE[0], min(STAGE[1], size))
    small = running(chapters.select("book_id", "chapter_number", F.lit(1).alias("one")), "book_id", "chapter_number", ("one",))
    places = small.select(F.col("book_id").alias("__book"), F.col("chapter_number").alias("__chapter"), F.floor(F.col("before_one") / size).alias("stage"))
    ends = places.groupBy("__book", "stage").agg(F.min("__chapter").alias("opens"), F.max("__chapter").alias("closes"))
    both = places.join(ends.withColumnsRenamed({"__book": "__b", "stage": "__s"}), F.col("__book").eqNullSafe(F.col("__b")) & (F.col("stage") == F.col("__s"))).drop("__b", "__s")
    return chapters.join(both, F.col("book_id").eqNullSafe(F.col("__book")) & (F.col("chapter_number") == F.col("__chapter"))).drop("__book", "__chapter")


def stage_prompts(chapters: DataFrame, summaries: DataFrame, prompt: Callable, size: int = 10) -> DataFrame:
    """(book_id, stage, opens, closes, prompt) of the stages with a summary. ``prompt``: a function of the columns opens, closes and the lines of the stage (one a chapter with a summary, in order) that gives the text for the model."""
    told = staged(chapters.select("book_id", "chapter_number", "title"), size).join(summaries.select("book_id", "chapter_number", "summary"), ["book_id", "chapter_number"])
    line = F.concat(F.lit("第 "), "chapter_number", F.lit(" 章《"), "title", F.lit("》："), "summary")
    lines = told.groupBy("book_id", "stage", "opens", "closes").agg(F.array_sort(F.collect_list(F.struct("chapter_number", line.alias("line")))).alias("x"))  # a stage has few
    return lines.select("book_id", "stage", "opens", "closes", prompt(F.col("opens"), F.col("closes"), F.array_join("x.line", "\n")).alias("prompt"))


def with_recaps(chapters: DataFrame, summaries: DataFrame, prompt: Callable, client: Callable, size: int = 10) -> DataFrame:
    """(book_id, chapter_number, summary): chapter summaries, and behind that of a stage's last chapter the stage's recap; a last chapter without a summary gets the recap alone.

    ``client`` makes the model, once a task (``payloads.complete``). A stage whose answer fails, is malformed or empty has no recap, and its summaries stay.
    """
    answers = complete(stage_prompts(chapters, summaries, prompt, size), "prompt", client)
    said = F.substring(T.strip(F.coalesce(tolerant(F.col("answer"), "struct<stage_summary:string>")["stage_summary"], F.lit(""))), 1, RECAP)
    recap = F.concat(F.lit(" | 阶段回顾（第 "), "opens", F.lit("-"), "closes", F.lit(" 章）："), said)
    recaps = answers.withColumn("__said", said).filter("__said <> ''").select("book_id", F.col("closes").alias("chapter_number"), recap.alias("recap"))
    both = summaries.select("book_id", "chapter_number", "summary").join(recaps, ["book_id", "chapter_number"], "full_outer")
    return both.select("book_id", "chapter_number", F.concat(F.coalesce("summary", F.lit("")), F.coalesce("recap", F.lit(""))).alias("summary"))
