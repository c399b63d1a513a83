"""Retrieval: postings, lexical search, exact text search, exact vectors, rerank windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

TOP_PARENTS, TOP_CHILDREN = 4, 10
RERANK_CHARS = 384


def postings(chunks: DataFrame) -> DataFrame:
    """(book_id, token, chunk_id, chapter_number): the inverted index; write it clustered by token, so that a search reads a few files."""
    return chunks.select("book_id", "chapter_number", "chunk_id", F.explode(T.tokens(F.col("text"))).alias("token"))


def write_postings(chunks: DataFrame, path: str, files: int = 64) -> None:
    postings(chunks).repartitionByRange(files, "token").sortWithinPartitions("token").write.parquet(path)


def candidates(index: DataFrame, query: str) -> DataFrame:
    """Ids of the chunks that hold a precise token of the query."""
    wanted = index.sparkSession.range(1).select(F.explode(T.candidate_tokens(T.tokens(F.lit(query)))).alias("token"))
    return index.join(F.broadcast(wanted), "token", "left_semi").select("book_id", "chunk_id").distinct()


def query_tokens(spark: SparkSession, query: str) -> tuple[list[str], list[str]]:
    """(all tokens, precise tokens) of a query."""
    every = T.tokens(F.lit(query))
    return tuple(spark.range(1).select(every.alias("a"), T.candidate_tokens(every).alias("c")).first())


def lexical_hits(chunks: DataFrame, query: str, max_chapter: int | None = None) -> DataFrame:
    """``chunks`` with ``score`` over 0.

    A book's candidates are the chunks that hold a precise token of the query; only if the whole book has none, all its chunks are. The bound on chapters comes after.
    Whether a chunk has a token is one regular expression; only candidates are cut into tokens, and once, behind a generator.
    """
    every, precise = query_tokens(chunks.sparkSession, query)
    hit = F.lower(F.coalesce("text", F.lit(""))).rlike(T.token_pattern(precise))
    found = chunks.groupBy("book_id").agg(F.max(hit).alias("__any"))
    rows = chunks.join(F.broadcast(found), "book_id").filter(hit | ~F.col("__any")).drop("__any")  # a row a book
    rows = rows if max_chapter is None else rows.filter(F.col("chapter_number") <= max_chapter)
    score = T.let(T.tokens(F.col("text")), lambda d: T.lexical_score(_texts(every), d, F.lit(query), F.col("text")))
    return rows.select("*", F.inline(F.array(F.struct(score.alias("score"))))).filter("score > 0")


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def best_per_parent(hits: DataFrame, top: int = TOP_PARENTS, by_book: bool = True) -> DataFrame:
    """The best chunk of each parent, then the ``top`` best of a book (or of all): by score, chapter, parent, chunk."""
    keys = ["book_id"] if by_book else []
    order = [F.desc("score"), "chapter_number", "parent_id", "chunk_id"]
    one = hits.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "parent_id").orderBy(*order))).filter("__r = 1").drop("__r")
    if not by_book:
        return one.orderBy(*order).limit(top)
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("book_id").orderBy(*order))).filter(F.col("rank") <= top)


def lexical_search(chunks: DataFrame, query: str, max_chapter: int | None = None, top: int = TOP_PARENTS) -> DataFrame:
    """The best parents of each book."""
    return best_per_parent(lexical_hits(chunks, query, max_chapter), top)


def exact_search(chapters: DataFrame, keyword: str, max_chapter: int | None = None, limit: int = 12, context: int = 120) -> DataFrame:
    """The first occurrence in each chapter with its surroundings, in chapter order; limit 1 to 50 and context 20 to 500, as clamped."""
    limit, context = max(1, min(50, limit)), max(20, min(500, context))
    rows = chapters.filter(F.contains(F.col("content"), F.lit(keyword)) & F.lit(keyword != ""))
    rows = rows if max_chapter is None else rows.filter(F.col("chapter_number") <= max_chapter)
    at = F.instr("content", F.lit(keyword)) - 1
    start = F.greatest(at - context, F.lit(0))
    end = F.least(F.length("content"), at + len(keyword) + context)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), T.strip(F.substring("content", start + 1, end - start)), F.when(end < F.length("content"), "...").otherwise(""))
    first = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_number"))
    return rows.select("book_id", "chapter_number", at.alias("position"), cut.alias("excerpt")).withColumn("rank", first).filter(F.col("rank") <= limit).withColumn("score", 1.0 / F.col("rank"))


def normalized(v: Column) -> Column:
    """A vector of length 1; zero vectors stay."""
    def by(n: Column) -> Column:
        return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))

    return T.let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), by)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_hits(rows: DataFrame, query: list[float], top: int | None = None, vector: str = "embedding") -> DataFrame:
    """The nearest rows by cosine, with ``score``: exact, and only ``top`` rows leave each task. By default as many as later filters need."""
    top = top or max(8 * TOP_CHILDREN, 12 * TOP_PARENTS, 32)
    q = normalized(F.array(*[F.lit(float(x)) for x in query]))
    return rows.withColumn("score", F.round(dot(normalized(F.col(vector)), q), 6)).orderBy(F.desc("score"), "chunk_id").limit(top)


def vector_search(rows: DataFrame, query: list[float], max_chapter: int | None = None, prefilter: bool = False, top: int = TOP_PARENTS) -> DataFrame:
    """Best parents by cosine. The bound on chapters comes after the nearest are taken, so fewer than ``top`` may be left; ``prefilter`` puts it before."""
    if prefilter and max_chapter is not None:
        rows = rows.filter(F.col("chapter_number") <= max_chapter)
    hits = vector_hits(rows, query)
    hits = hits if max_chapter is None else hits.filter(F.col("chapter_number") <= max_chapter)
    return best_per_parent(hits.withColumn("book_id", F.lit("")), top, by_book=False).drop("book_id")


def rerank_windows(rows: DataFrame, child: Column, parent: Column, into: str = "passage", limit: int = RERANK_CHARS) -> DataFrame:
    """``rows`` with at most ``limit`` characters of the parent around the child: the child in the middle as far as the parent has text on both sides.

    Each figure is a column of its own, so none is worked out twice.
    """
    out = rows.withColumns({"__c": T.strip(F.coalesce(child, F.lit(""))), "__p": T.strip(F.coalesce(parent, F.lit("")))})
    out = out.withColumns({"__n": F.length("__p"), "__m": F.length("__c"), "__at": F.when(F.col("__c") == "", 0).otherwise(F.instr("__p", F.substring("__c", 1, 120)))})
    # Within the parent: the child's first and last place (0-based, end exclusive), then what the limit leaves for both sides.
    out = out.withColumn("__end", F.least(F.col("__n"), F.col("__at") - 1 + F.col("__m")))
    out = out.withColumn("__room", F.greatest(F.lit(0), limit + F.col("__at") - 1 - F.col("__end")))
    out = out.withColumn("__left", F.greatest(F.lit(0), F.col("__at") - 1 - F.expr("__room div 2")))
    out = out.withColumn("__right", F.least(F.col("__n"), F.col("__end") + F.col("__room") + F.col("__left") - F.col("__at") + 1))
    out = out.withColumn("__left", F.when(F.col("__right") - F.col("__left") < limit, F.least(F.col("__left"), F.greatest(F.lit(0), F.col("__right") - limit))).otherwise(F.col("__left")))
    around = F.substring(F.col("__p"), (F.col("__left") + 1).cast("int"), (F.col("__right") - F.col("__left")).cast("int"))
    joined = F.substring(F.concat("__c", F.lit("\n"), F.substring(F.col("__p"), F.lit(1), F.greatest(F.lit(0), limit - F.col("__m") - 1))), 1, limit)
    passage = F.when(F.col("__n") == 0, F.substring("__c", 1, limit)).when(F.col("__n") <= limit, F.col("__p")).when(F.col("__at") > 0, around).when(F.col("__m") == 0, F.substring("__p", 1, limit)).otherwise(joined)
    return out.withColumn(into, passage).drop("__c", "__p", "__n", "__m", "__at", "__end", "__room", "__left", "__right")


def score_of(raw: Column) -> Column:
    """A scorer's output as a number: of several the largest; what isn't a number is 0."""
    x = F.array_max(F.transform(raw, lambda v: v.cast("double")))
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)


def reranker(model):
    """A Column function of (query, passage) from ``model()``, which gives, once a task, a function from pairs to a list of scores each."""

    def of(query: Column, passage: Column) -> Column:
        @F.pandas_udf("array<double>")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            m = model()
            for q, p in batches:
                yield pd.Series([list(map(float, x)) if isinstance(x, (list, tuple)) else [float(x)] for x in m(list(zip(q, p, strict=True)))])

        return score_of(score(query, passage))

    return of


def widened(top: int, candidates: int) -> int:
    """How many candidates a reranked search asks its base for."""
    return max(top, 4, min(100, candidates))


def rerank(hits: DataFrame, score: Column, top: int = TOP_PARENTS) -> DataFrame:
    """Hits by a second score (of an injected scorer), the base's ``widened`` candidates; a single hit stays as it is."""
    return hits.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), "chapter_number", "parent_id").limit(top)


def choose(method: str, lexical, vector, has_vectors: bool):
    """The retriever for ``lexical``, ``embedding`` or ``auto``, which is vectors where a book has them. Each is a function (query, max_chapter) -> DataFrame."""
    if method not in ("lexical", "embedding", "auto"):
        raise ValueError(f"unknown retriever: {method}")
    if method == "embedding" and not has_vectors:
        raise ValueError("the book has no vectors")
    return vector if has_vectors and method != "lexical" else lexical


def highlight(content: Column, excerpt: Column) -> Column:
    """1-based place of an excerpt's first 80 characters in a chapter, else of their first half if that has 24; 0 if absent."""
    head = F.substring(T.strip(excerpt), 1, 80)
    half = F.substring(head, F.lit(1), F.floor(F.length(head) / 2).cast("int"))
    return F.when(F.instr(content, head) > 0, F.instr(content, head)).when(F.length(half) >= 24, F.instr(content, half)).otherwise(0)


def expanded(child: Column, parent: Column, before: int = 180, after: int = 480) -> Column:
    """The parent's text from ``before`` characters ahead of the child's first 80 to ``after`` behind."""
    at = F.instr(parent, F.substring(child, 1, 80)) - 1
    start = F.greatest(at - before, F.lit(0))
    return F.when(at < 0, child).otherwise(F.substring(parent, start + 1, F.least(F.length(parent), at + after) - start))
