"""Books into chapters, chapters into overlapping two-level chunks."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .batches import portions

#: Default sizes: characters of a chunk and of its overlap with the one before.
PARENT, CHILD = (1800, 200), (260, 40)
LOOK_AHEAD, LEAST_SHARE = 80, 0.6


#: So many successive numbers of a key make a block; only totals of blocks meet the whole key.
BLOCK = 1024


def running(rows: DataFrame, key: str, at: str, sums: tuple[str, ...], lasts: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``before_<column>`` for the sum, or the last value that isn't null, over the rows of the same key before each row, in the order of ``at`` (a whole number).

    Rows are windowed in blocks of ``at``, and one row a block is windowed by key, so that a key with most of the rows still takes many tasks.
    """
    rows = rows.withColumn("__block", F.floor(F.col(at) / BLOCK))
    inside = Window.partitionBy(key, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    last_of = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in lasts]
    totals = rows.groupBy(key, "__block").agg(*[F.sum(c).alias(c) for c in sums], *last_of)
    totals = totals.select(
        F.col(key).alias("__key"), F.col("__block").alias("__of"), *[F.coalesce(F.sum(c).over(blocks), F.lit(0)).alias(f"__{c}") for c in sums], *[F.last(c, ignorenulls=True).over(blocks).alias(f"__{c}") for c in lasts]
    )
    own = {f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums} | {f"before_{c}": F.last(c, ignorenulls=True).over(inside) for c in lasts}
    both = rows.withColumns(own).join(totals, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of")))
    added = {f"before_{c}": F.col(f"before_{c}") + F.col(f"__{c}") for c in sums} | {f"before_{c}": F.coalesce(f"before_{c}", f"__{c}") for c in lasts}
    return both.withColumns(added).drop("__block", "__of", "__key", *[f"__{c}" for c in (*sums, *lasts)])


def parse_chapters(books: DataFrame, joined: str = "\n\n") -> DataFrame:
    """(book_id, chapter_number, title, content, start_offset, end_offset) from (book_id, text) or, for books too long for a row, (book_id, part, text) with parts numbered in order.

    Parts are read as if joined by a blank line, or, with ``joined`` a line end, as lines of one text (``readers.book_parts``). Lines are sessionised: a chapter heading opens a chapter with its title, scoped by the last volume heading; a volume heading only closes one.
    Numbers are dense. A book without chapter headings is one chapter. Lines are windowed inside their part, and what a part hands on to the next is a row of totals (``running``), so the
    longest row is a part or a chapter, not a book.
    """
    part = F.col("part") if "part" in books.columns else F.lit(0)
    clean = books.select("book_id", part.alias("part"), T.normalize_newlines(F.coalesce("text", F.lit(""))).alias("text"))
    lines = clean.select("book_id", "part", F.posexplode(F.split(F.concat("text", F.lit(joined[1:])), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("vol", T.is_volume(F.col("line"))).withColumn("head", ~F.col("vol") & T.is_chapter(F.col("line")))
    w = Window.partitionBy("book_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns(
        {
            "piece": F.sum((F.col("vol") | F.col("head")).cast("int")).over(w),
            "volume": F.last(F.when(F.col("vol"), T.clean_volume(F.col("line"))), ignorenulls=True).over(w),
        }
    )
    pieces = lines.groupBy("book_id", "part", "piece").agg(
        F.max(F.when(F.col("head"), T.clean_title(F.col("line")))).alias("heading"),
        F.max("volume").alias("volume"),  # a piece has one
        F.array_sort(F.collect_list(F.when(~F.col("vol") & ~F.col("head"), F.struct("pos", "line")))).alias("ls"),
    )
    of_part = pieces.groupBy("book_id", "part").agg(F.max("piece").alias("cuts"), F.max_by("volume", "piece").alias("volume"))
    carried = running(of_part, "book_id", "part", ("cuts",), ("volume",)).select(F.col("book_id").alias("__book"), F.col("part").alias("__part"), "before_cuts", "before_volume")
    pieces = pieces.join(carried, F.col("book_id").eqNullSafe(F.col("__book")) & (F.col("part") == F.col("__part")))
    scope = F.coalesce("volume", "before_volume")
    pieces = pieces.select(
        "book_id", (F.col("piece") + F.col("before_cuts")).alias("seg"), "part", "heading", F.when(scope.isNull(), F.col("heading")).otherwise(F.concat_ws(" / ", scope, "heading")).alias("scoped"),
        F.when(F.size("ls") > 0, F.array_join("ls.line", "\n")).alias("text"),
    )
    segs = pieces.groupBy("book_id", "seg").agg(
        F.max(F.when(F.col("heading").isNotNull(), F.col("scoped"))).alias("title"),
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("part", "text")))).alias("texts"),
    )
    segs = segs.withColumn("content", T.strip(F.array_join("texts.text", "\n"))).withColumn("title", F.coalesce("title", F.lit(""))).drop("texts")
    with_heading = lines.filter("head").select(F.col("book_id").alias("__book")).distinct()
    segs = segs.join(with_heading, F.col("book_id").eqNullSafe(F.col("__book")), "left_semi").filter("title <> '' or content <> ''")
    size = F.length(T.strip(F.concat("title", F.lit("\n"), "content")))
    small = segs.select("book_id", "seg", F.lit(1).alias("one"), (size + 2).alias("length"))
    places = running(small, "book_id", "seg", ("one", "length")).select(F.col("book_id").alias("__book"), F.col("seg").alias("__seg"), (F.col("before_one") + 1).cast("int").alias("chapter_number"), F.col("before_length").alias("start_offset"))
    found = segs.join(places, F.col("book_id").eqNullSafe(F.col("__book")) & (F.col("seg") == F.col("__seg"))).select(
        "book_id", "chapter_number", F.when(F.col("title") == "", F.concat(F.lit("第"), "chapter_number", F.lit("章"))).otherwise(F.col("title")).alias("title"),
        F.when(F.col("content") == "", F.col("title")).otherwise(F.col("content")).alias("content"), "start_offset", (F.col("start_offset") + size).alias("end_offset"),
    )
    plain = source_text(clean.join(with_heading, F.col("book_id").eqNullSafe(F.col("__book")), "left_anti").select("book_id", F.col("part").alias("chapter_number"), F.col("text").alias("content")), joined)
    whole = plain.select("book_id", F.lit(1).alias("chapter_number"), F.lit("全文").alias("title"), T.strip(F.col("text")).alias("content"), F.lit(0).cast("long").alias("start_offset"))
    return found.unionByName(whole.withColumn("end_offset", F.length("content").cast("long")))


def windows_of(size: int, stops: list[int], target: int, overlap: int):
    """(begin, end) of each window over ``size`` characters; ``stops`` are the places behind sentence ends, in order. A window goes to the last stop in reach if that leaves it long enough."""
    begin, shortest = 0, int(target * LEAST_SHARE) + 1
    while size - begin > target:
        reach = bisect_right(stops, min(size, begin + target + LOOK_AHEAD))
        stop = stops[reach - 1] if reach else 0
        end = stop if stop > begin + shortest else begin + target
        yield begin, end
        if end == size:
            return
        begin = max(begin + 1, end - overlap)
    if begin < size:
        yield begin, size


def spans(text: str, target: int, overlap: int, ends: str = "。\n") -> list[str]:
    """Overlapping windows that end at the last sentence end in reach, if that is beyond 60 % of the target; without those that are blank."""
    body = text.strip()
    stops = [m.end() for m in re.finditer(f"[{re.escape(ends)}]", body)]
    return [piece for i, j in windows_of(len(body), stops, target, overlap) if (piece := body[i:j].strip())]


def _cut(target: int, overlap: int, ends: str):
    @F.arrow_udf("array<string>")
    def cut(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            for i, j in portions(column):
                yield pa.array([spans(t or "", target, overlap, ends) for t in column.slice(i, j - i).to_pylist()], pa.list_(pa.string()))

    return cut


def chunk_hierarchy(chapters: DataFrame, parent: tuple[int, int] = PARENT, child: tuple[int, int] = CHILD, ends: str = "。\n") -> tuple[DataFrame, DataFrame]:
    """(parents, children) of (book_id, chapter_number, title, content); ids carry the lineage. A window starts where the one before ended, so the cut is one Arrow call a batch of texts."""
    cut = chapters.select("book_id", "chapter_number", F.col("title").alias("chapter_title"), F.posexplode(_cut(*parent, ends)("content")).alias("chunk_index", "text"))
    parents = cut.withColumn("chunk_id", F.concat_ws(":", "book_id", F.lit("p"), "chapter_number", "chunk_index"))
    pieces = parents.select("book_id", "chapter_number", F.col("chunk_id").alias("parent_id"), F.posexplode(_cut(*child, ends)("text")).alias("chunk_index", "text"))
    children = pieces.withColumn("chunk_id", F.concat_ws(":", "parent_id", F.lit("c"), "chunk_index"))
    return parents, children


def search_rows(parents: DataFrame, children: DataFrame, max_chapter: int | None = None) -> DataFrame:
    """Children with their parent's text and title, up to a chapter."""
    p = parents.select(F.col("chunk_id").alias("parent_id"), "chapter_title", F.col("text").alias("parent_text"))
    rows = children if max_chapter is None else children.filter(F.col("chapter_number") <= max_chapter)
    return rows.join(p, "parent_id")


def source_text(chapters: DataFrame, joined: str = "\n\n") -> DataFrame:
    """Each book's text, rebuilt from its chapters, as one row a book: for books that fit into a row. ``source_parts`` is for all others."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chapter_number", "content"))), lambda x: x["content"])
    return chapters.groupBy("book_id").agg(F.array_join(ordered, joined).alias("text"))


def source_parts(chapters: DataFrame) -> DataFrame:
    """(book_id, part, text): each book's text as a row a chapter, in order, which ``parse_chapters`` reads as the text of ``source_text``."""
    return chapters.select("book_id", F.col("chapter_number").alias("part"), F.col("content").alias("text"))


def fingerprint(chapters: DataFrame, version: str, settings: dict) -> DataFrame:
    """24 hex digits of a SHA-256 over version, settings and chapters, a book. The hash takes one chapter after another, so a book is one task's work but never one row or group in memory."""
    # The settings that count, in this order.
    keys = ("enabled", "max_chapters", "batch_chapters", "model_path", "endpoint")
    head = (version + "".join(str(settings.get(k, "")) + "\0" for k in keys)).encode()
    piece = F.concat(F.col("chapter_number").cast("string"), "title", "content", F.lit("\0"))

    def run(batches):
        book = state = None
        for batch in batches:
            for own, text in zip(batch["book_id"], batch["piece"], strict=True):
                if state is None or own != book:
                    if state is not None:
                        yield pd.DataFrame({"book_id": [book], "fingerprint": [state.hexdigest()[:24]]})
                    book, state = own, hashlib.sha256(head)
                state.update((text or "").encode())
        if state is not None:
            yield pd.DataFrame({"book_id": [book], "fingerprint": [state.hexdigest()[:24]]})

    rows = chapters.select("book_id", "chapter_number", "title", "content", piece.alias("piece")).repartition("book_id").sortWithinPartitions("book_id", "chapter_number", "title", "content")
    return rows.select("book_id", "piece").mapInPandas(run, f"book_id {chapters.schema['book_id'].dataType.simpleString()}, fingerprint string")


def warnings(stats: DataFrame) -> DataFrame:
    """Adds ``warnings`` (array of codes) to (chapter_count, entity_count, event_count, summary_count, vector_status)."""
    rules = [(F.col("chapter_count") <= 1, "few_chapters"), (F.col("entity_count") == 0, "no_entities"), (F.col("event_count") == 0, "no_events"), (F.col("summary_count") == 0, "no_summaries"), (F.col("vector_status") != "built", "no_vectors")]
    return stats.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules])))


def quality_report(chapters: DataFrame, entities: DataFrame, events: DataFrame, summaries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(book_id, chapter_count, entity_count, event_count, summary_count, vector_status, warnings): what a build gave, a row a book of ``chapters``. Vectors are ``built`` where a book has any, else ``missing``.

    Tables are counted by book before they meet, so no two of them are joined row by row.
    """
    count = lambda rows, into: rows.groupBy("book_id").agg(F.count("*").alias(into))
    out = count(chapters, "chapter_count")
    for rows, into in ((entities, "entity_count"), (events, "event_count"), (summaries, "summary_count"), (vectors, "__vectors")):
        out = out.join(count(rows, into), "book_id", "left").withColumn(into, F.coalesce(into, F.lit(0)))
    return warnings(out.withColumn("vector_status", F.when(F.col("__vectors") > 0, "built").otherwise("missing")).drop("__vectors"))
