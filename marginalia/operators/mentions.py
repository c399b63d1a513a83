"""Mention tables: entities, themes, relations and events found in chapters by a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.names import in_publishing_context, is_candidate
from . import matching
from .ingest import running

# Cue words of event and relation types, in the order in which they are tried.
EVENT_TYPES = (
    ("获得/失去", ("拿到", "得到", "获得", "失去", "夺走", "交出", "打开")),
    ("冲突/危机", ("对峙", "追杀", "争斗", "袭击", "背叛", "怀疑", "危机")),
    ("揭示/真相", ("发现", "揭开", "真相", "意识到", "明白", "提到", "告诉")),
    ("选择/决定", ("决定", "选择", "相信", "拒绝", "承认", "承担")),
    ("协作/同行", ("一起", "同行", "帮助", "救", "穿过", "合作")),
)
RELATION_TYPES = (
    ("师徒/传承", ("师父", "师尊", "弟子", "传授", "教导")),
    ("冲突", ("敌", "追杀", "背叛", "杀", "冲突", "争斗", "对峙")),
    ("同伴/协作", ("朋友", "同伴", "一起", "同行", "帮助", "救")),
    ("亲缘/家族", ("父", "母", "兄", "姐", "弟", "妹", "家族")),
)
NO_EVENT, NO_RELATION = "事件", "共现/关联"
EXCERPT, SUMMARY, PAD = 120, 72, 60


def mentions(chapters: DataFrame, names: DataFrame, pad: int = PAD) -> DataFrame:
    """(book_id, name, chapter_number, surface, position, excerpt, mention_no): every occurrence of a surface in a chapter; those of one surface don't overlap, but nested names both count.

    ``names``: (name, surface), a dictionary; all its surfaces are found in one go through a text (``matching``), and texts aren't moved.
    """
    at = matching.occurrences(chapters.select("book_id", "chapter_number", "content"), "content", names)
    cut = T.excerpt(F.col("content"), F.col("position"), F.length("surface"), pad)
    at = at.select("book_id", "chapter_number", "surface", "position", cut.alias("excerpt"))
    return numbered(at.join(names.select("name", "surface").distinct(), "surface"), ["book_id", "name"])


def numbered(rows: DataFrame, keys: list[str], into: str = "mention_no", order=("position", "surface")) -> DataFrame:
    """Adds ``into``: the place (from 1) of a row of its keys, by chapter and ``order``. Rows are numbered inside their chapter, and counts of chapters are added up (``running``), so a name with most of the rows takes many tasks."""
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    counts = running(rows.groupBy(*keys, "chapter_number").agg(F.count("*").alias("n")).withColumn("__keys", key), "__keys", "chapter_number", ("n",))
    counts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("chapter_number").alias("__chapter"), "before_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "chapter_number").orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    both = rows.withColumn("__no", inside).join(counts, [*same, F.col("chapter_number") == F.col("__chapter")])
    return both.withColumn(into, (F.col("__no") + F.col("before_n")).cast("int")).drop("__no", "__chapter", "before_n", *[f"__k{i}" for i in range(len(keys))])


def rollup(found: DataFrame) -> DataFrame:
    """First chapter and count of each name that has a mention."""
    return found.groupBy("book_id", "name").agg(F.min("chapter_number").alias("first_chapter_number"), F.count("*").alias("mention_count"))


def windows(chapters: DataFrame, names: DataFrame, column) -> DataFrame:
    """(book_id, chapter_number, window_no, sentence, names): sentences with the sorted dictionary names that they contain, all found in one go through a sentence."""
    cut = chapters.select("book_id", "chapter_number", F.posexplode(column).alias("window_no", "sentence"))
    return matching.contained(cut, "sentence", names).filter(F.size("names") > 0)


def relations(found: DataFrame, types=RELATION_TYPES) -> DataFrame:
    """(book_id, source, target, relation_type, chapter_number, window_no, sentence): ordered pairs of names in a window that has a type's cue."""
    typed = found.filter(F.size("names") > 1).withColumn("relation_type", T.first_match(F.col("sentence"), types, NO_RELATION)).filter(F.col("relation_type") != NO_RELATION)
    left = typed.select("*", F.posexplode("names").alias("i", "source"))
    pairs = left.select("*", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("target"))
    return pairs.select("book_id", "source", "target", "relation_type", "chapter_number", "window_no", "sentence")


def relation_rollup(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("book_id", "source", "target", "relation_type").agg(F.min("chapter_number").alias("first_chapter_number"), F.count("*").alias("mention_count"))


def band_relations(found: DataFrame, pairs: DataFrame, reach: int = EXCERPT) -> DataFrame:
    """For books without any typed relation: pairs of names whose first mentions in a chapter are within ``reach`` characters."""
    bare = found.join(pairs.select("book_id").distinct(), "book_id", "left_anti")
    first = bare.groupBy("book_id", "chapter_number", "name").agg(F.min("position").alias("position"))
    a, b = first.alias("a"), first.alias("b")
    near = (F.col("a.name") < F.col("b.name")) & (F.abs(F.col("a.position") - F.col("b.position")) <= reach)
    keys = ["book_id", "chapter_number"]
    return a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [near]).select("a.book_id", "a.chapter_number", F.col("a.name").alias("source"), F.col("b.name").alias("target"), F.lit(NO_RELATION).alias("relation_type"))


def events(found: DataFrame, types=EVENT_TYPES) -> DataFrame:
    """(book_id, chapter_number, event_type, summary, excerpt, names): eventful sentences with a name, once a chapter."""
    typed = found.withColumn("event_type", T.first_match(F.col("sentence"), types, NO_EVENT)).filter(F.col("event_type") != NO_EVENT)
    once = F.row_number().over(Window.partitionBy("book_id", "chapter_number", "sentence").orderBy("window_no")) == 1
    kept = typed.withColumn("__once", once).filter("__once")
    return kept.select("book_id", "chapter_number", "window_no", "event_type", T.clip(F.col("sentence"), SUMMARY).alias("summary"), T.clip(F.col("sentence"), EXCERPT).alias("excerpt"), "names")


def ngram_counts(texts: DataFrame, sizes=(2, 3, 4), run: str = "[一-鿿]{4,}", least: int = 8) -> DataFrame:
    """(gram, n): character n-grams inside runs of a pattern that occur at least ``least`` times. Equal runs are counted first, so grams are cut once a distinct run."""
    def grams(s, n):
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    runs = texts.select(F.explode(F.regexp_extract_all("content", F.lit(run), F.lit(0))).alias("s")).groupBy("s").agg(F.count("*").alias("times"))
    each = runs.select("times", F.explode(F.concat(*[grams(F.col("s"), n) for n in sizes])).alias("gram"))
    return each.groupBy("gram").agg(F.sum("times").alias("n")).filter(F.col("n") >= least)


def longest_first(counts: DataFrame, top: int = 60) -> DataFrame:
    """(gram, n): the first ``top`` grams that are inside no other gram, longest first, then the commonest. A gram's own parts are exploded and taken away, so nothing is compared pair by pair."""
    size = F.length("gram")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring(F.col("gram"), i, k))))
    inside = counts.filter(size > 1).select(F.explode(parts).alias("gram")).distinct()
    return counts.join(inside, "gram", "left_anti").orderBy(F.length("gram").desc(), F.desc("n"), "gram").limit(top)


def bracketed(texts: DataFrame, patterns=("【([^】]{1,20})】", "《([^》]{1,20})》", "「([^」]{1,20})」")) -> DataFrame:
    """Distinct bracketed names of 2 to 20 characters without blanks or marks, longest first."""
    found = texts.select(F.explode(F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns])).alias("name"))
    ok = F.length("name").between(2, 20) & ~F.col("name").rlike(r"(?U)[\s，。！？；：、“”‘’（）()《》【】\[\]{}<>]") & F.col("name").rlike(T.CJK)
    return found.filter(ok).distinct().orderBy(F.length("name").desc(), "name")


def discovered(texts: DataFrame, top: int = 60, least: int = 8) -> DataFrame:
    """(name): a book's likely names, longest first, from texts (column content): counted CJK runs of 2 to 4 that may be names (``names.is_candidate``), the first ``top`` that are inside no longer one; and
    bracketed names that stand at least once where the text doesn't speak of books (``names.in_publishing_context``). Candidates are sifted before the longest are taken, so that a longer run that is no name hides none.
    """
    counted = longest_first(ngram_counts(texts, least=least).filter(is_candidate(F.col("gram"))), top).select(F.col("gram").alias("name"))
    texts = texts.filter(F.col("content").rlike("[【《「]"))  # others have no bracketed names
    told = bracketed(texts).select("name")
    patterns = ("【([^】]{1,20})】", "《([^》]{1,20})》", "「([^」]{1,20})」")
    found = texts.select("content", F.explode(F.array_distinct(F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(0)) for p in patterns]))).alias("raw"))
    at = found.select("content", "raw", F.explode(T.positions(F.col("content"), F.col("raw"))).alias("at"))
    story = at.filter(~in_publishing_context(F.col("content"), F.col("at"), F.length("raw"))).select(F.expr("substring(raw, 2, length(raw) - 2)").alias("name")).distinct()
    return counted.union(told.join(story, "name", "left_semi")).distinct().orderBy(F.length("name").desc(), "name")


def sample_chapters(chapters: DataFrame, first: int | None = None, stride: int = 1, batch: int = 1) -> DataFrame:
    """The first chapters of each book, or every ``stride``-th and always the last; with the number of the batch."""
    w = Window.partitionBy("book_id").orderBy("chapter_number")
    rows = chapters.withColumn("rn", F.row_number().over(w)).withColumn("last", F.count("*").over(Window.partitionBy("book_id")))
    rows = rows.filter(F.col("rn") <= first) if first else rows
    rows = rows.filter(((F.col("rn") - 1) % stride == 0) | (F.col("rn") == F.col("last")))
    return rows.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / batch)).drop("rn", "last")
