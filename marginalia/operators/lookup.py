"""Look-ups over mention tables: names and aliases, first appearance, timelines, stages, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import matching

STAGES = ("start", "middle", "recent")


def bounded(rows: DataFrame, max_chapter: int | None) -> DataFrame:
    """No row beyond the reader's chapter."""
    return rows if max_chapter is None else rows.filter(F.col("chapter_number") <= max_chapter)


def clamp(asked: int | None, progress: int | None) -> int | None:
    """The stricter of what is asked for and what is stored."""
    known = [x for x in (asked, progress) if x is not None]
    return min(known) if known else None


def resolve(surfaces: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, name): the dictionary name of each surface, direct matches before aliases, on normalised forms."""
    key = T.normalize_name(F.col("surface"))
    direct = names.select(T.normalize_name(F.col("name")).alias("k"), F.col("name").alias("d")).dropDuplicates(["k"])
    other = aliases.groupBy(T.normalize_name(F.col("alias")).alias("k")).agg(F.min("name").alias("a"))
    return surfaces.withColumn("k", key).join(direct, "k", "left").join(other, "k", "left").select("surface", F.coalesce("d", "a").alias("name")).filter("name is not null")


def names_in(questions: DataFrame, names: DataFrame, aliases: DataFrame, text: str = "question") -> DataFrame:
    """``questions`` with name, surface, kind (0: a name, 1: an alias) and rank: the dictionary names that each ``text`` has, by their best surface: names before aliases, then the longest.

    All surfaces are found in one go through a text (``matching``); questions need distinct rows, as an id gives them. ``rank`` orders a question's names by kind, length and name.
    """
    rows = names.select("name", F.col("name").alias("surface"), F.lit(0).alias("kind")).union(aliases.select("name", F.col("alias").alias("surface"), F.lit(1).alias("kind")))
    keys = [f"`{c}`" for c in questions.columns]
    met = matching.contained(questions, text, rows, "__found").select(*keys, F.explode("__found").alias("surface"))
    hits = met.join(rows.groupBy("name", "surface").agg(F.min("kind").alias("kind")), "surface")
    best = hits.groupBy(*keys, "name").agg(F.min(F.struct("kind", (-F.length("surface")).alias("size"), "surface")).alias("b"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("b.kind", "b.size", "name"))
    return best.select(*keys, "name", "b.surface", "b.kind", rank.alias("rank"))


def with_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names with their aliases joined by ``、``, in order."""
    listed = aliases.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("alias")), "、").alias("aliases"))
    return names.join(listed, "name", "left").withColumn("aliases", F.coalesce("aliases", F.lit("")))


def first_appearance(mentions: DataFrame, max_chapter: int | None = None) -> DataFrame:
    """The first mention of each name; beyond the bound it is ``blocked``, and neither chapter nor excerpt is told."""
    first = F.row_number().over(Window.partitionBy("book_id", "name").orderBy("chapter_number", "position", "surface"))
    rows = mentions.withColumn("r", first).filter("r = 1")
    blocked = F.lit(False) if max_chapter is None else F.col("chapter_number") > max_chapter
    hide = lambda c: F.when(~blocked, F.col(c)).alias(c)
    return rows.select("book_id", "name", blocked.alias("blocked"), hide("chapter_number"), hide("position"), hide("excerpt"))


def timeline(mentions: DataFrame, max_chapter: int | None = None, fragments: int = 3) -> DataFrame:
    """(book_id, name, chapters, n_mentions, rank, chapter_number, excerpt): the first fragments of each name, with how many chapters it is in."""
    rows = bounded(mentions, max_chapter)
    totals = rows.groupBy("book_id", "name").agg(F.countDistinct("chapter_number").alias("chapters"), F.count("*").alias("n_mentions"))
    order = F.row_number().over(Window.partitionBy("book_id", "name").orderBy("chapter_number", "position", "surface"))
    return rows.withColumn("rank", order).filter(F.col("rank") <= fragments).select("book_id", "name", "rank", "chapter_number", "excerpt").join(totals, ["book_id", "name"])


def stages(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments in thirds by (chapter, excerpt): of one, one stage; of two, two; else the first third, up to two thirds, and the rest. The remainder goes to later stages."""
    w = Window.partitionBy(*keys)
    rows = fragments.withColumn("i", F.row_number().over(w.orderBy("chapter_number", "excerpt")) - 1).withColumn("n", F.count("*").over(w))
    first = F.greatest(F.lit(1), F.expr("n div 3"))
    middle = F.greatest(first + 1, F.expr("(n * 2) div 3"))
    stage = F.when(F.col("n") <= 2, F.col("i") * 2).when(F.col("i") < first, 0).when(F.col("i") < middle, 1).otherwise(2)
    by_place = F.struct("chapter_number", "excerpt")
    return rows.withColumn("stage", stage.cast("int")).groupBy(*keys, "stage").agg(
        F.min("chapter_number").alias("chapter_start"), F.max("chapter_number").alias("chapter_end"), F.count("*").alias("excerpt_count"),
        F.min_by("excerpt", by_place).alias("first_excerpt"), F.max_by("excerpt", by_place).alias("last_excerpt"),
    )


def stages_of_chapters(mentions: DataFrame) -> DataFrame:
    """Stages of each name of a book."""
    return stages(mentions, ["book_id", "name"])


def relations_of(rollup: DataFrame, pairs: DataFrame, name: str, max_chapter: int | None = None) -> DataFrame:
    """Relations that touch a name, first seen within the bound; the whole book's count, and what is visible."""
    seen = bounded(pairs, max_chapter).groupBy("book_id", "source", "target", "relation_type").agg(F.count("*").alias("visible_mention_count"))
    rows = rollup.filter((T.normalize_name(F.col("source")) == T.normalize_name(F.lit(name))) | (T.normalize_name(F.col("target")) == T.normalize_name(F.lit(name))))
    rows = rows if max_chapter is None else rows.filter(F.col("first_chapter_number") <= max_chapter)
    return rows.join(seen, ["book_id", "source", "target", "relation_type"])


def node_weights(rollup: DataFrame) -> DataFrame:
    """Of each name: the mentions of its relations in all, and how many relations it has."""
    ends = rollup.select("book_id", F.explode(F.array("source", "target")).alias("name"), "mention_count")
    return ends.groupBy("book_id", "name").agg(F.sum("mention_count").alias("weight"), F.count("*").alias("degree"))


def event_search(events: DataFrame, tokens: list[str] = (), entity: str | None = None, max_chapter: int | None = None, limit: int = 20) -> DataFrame:
    """Events of a name; or, without one, those that hold each of up to five tokens in type, summary or excerpt, ASCII case aside, wildcards literal."""
    rows = bounded(events, max_chapter)
    if entity is not None:
        rows = rows.filter(F.array_contains("names", entity))
    else:
        for t in list(tokens)[:5]:
            like = f"%{T.escape_like(t)}%"
            rows = rows.filter(F.col("event_type").ilike(like) | F.col("summary").ilike(like) | F.col("excerpt").ilike(like))
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_number", "window_no"))
    return rows.withColumn("rank", order).filter(F.col("rank") <= limit)


# Words and separators that event queries drop.
QUERY_STOP = ("什么", "怎么", "如何", "为什么", "哪些", "关键", "事件", "主线", "发生", "后来", "关系", "变化", "了吗", "吗", "的", "了", "和", "与")
QUERY_BREAK = "[ ，。！？、；：,.!?;:]"
QUERY_SEPARATORS = r"[\s，。！？、；：,.!?;:《》【】\"'“”‘’]+"


def event_query_tokens(query: Column) -> Column:
    """The tokens of an event query (null: none) as an array: none if it is one long piece, eight at most, without stop words."""
    text = T.strip(F.coalesce(query, F.lit("")))
    useful = F.filter(F.split(text, QUERY_SEPARATORS), lambda x: (x != "") & ~x.isin(*QUERY_STOP))
    return F.when((F.length(text) > 8) & ~text.rlike(QUERY_BREAK), F.array().cast("array<string>")).otherwise(F.slice(useful, 1, 8))
