"""Books, chapters, summaries and names as lists and single answers; book metadata, progress and preferences; deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def book_list(books: DataFrame, group: str | None = None) -> DataFrame:
    """Books, newest first; of a group only, or with "" of none."""
    rows = books if group is None else books.filter(F.btrim(F.coalesce("group_name", F.lit(""))) == group)
    return rows.orderBy(F.desc("created_at"), "book_id")


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """The values of a column that aren't blank, once each, in order."""
    return rows.select(F.btrim(column).alias(column)).filter(f"`{column}` <> ''").distinct().orderBy(column)


def described(books: DataFrame, changes: DataFrame) -> DataFrame:
    """``books`` with group and tags from ``changes`` (book_id, group_name, tags), trimmed; blank and repeated tags go, in order of first use."""
    clean = F.array_distinct(F.filter(F.transform("c.tags", lambda x: F.btrim(x)), lambda x: x != ""))
    b, c = books.alias("b"), changes.alias("c")
    rest = [F.col(f"b.{x}") for x in books.columns if x not in ("group_name", "tags")]
    has = F.col("c.book_id").isNotNull()
    return b.join(c, F.col("b.book_id") == F.col("c.book_id"), "left").select(*rest, F.when(has, F.btrim("c.group_name")).otherwise(F.col("b.group_name")).alias("group_name"), F.when(has, clean).otherwise(F.col("b.tags")).alias("tags"))


def with_vectors(books: DataFrame, info: DataFrame) -> DataFrame:
    """Books with their vectors' number and width, and whether there are any."""
    return books.join(info, "book_id", "left").withColumn("has_vectors", F.col("chunk_count").isNotNull())


def counts_by_kind(tables: dict[str, DataFrame], key: str = "book_id") -> DataFrame:
    """One row a book: how many rows each table has of it, 0 where none. Each table is counted on its own, and only counts meet."""
    each = [df.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(kind).alias("kind"), "n") for kind, df in tables.items()]
    return reduce(DataFrame.unionByName, each).groupBy(key).pivot("kind", list(tables)).sum("n").na.fill(0)


def totals(stats: DataFrame) -> DataFrame:
    """Sums over all books of every number."""
    numbers = [c for c, t in stats.dtypes if t in ("int", "bigint")]
    return stats.agg(F.count("*").alias("books"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers])


def latest_chapter(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, latest): the largest chapter number of each book, 0 without chapters."""
    most = chapters.groupBy("book_id").agg(F.max("chapter_number").alias("latest"))
    return books.select("book_id").distinct().join(most, "book_id", "left").na.fill(0, ["latest"])


def chapter_list(chapters: DataFrame, book_id: str, limit: int | None = None) -> DataFrame:
    rows = chapters.filter(F.col("book_id") == book_id).select("book_id", "chapter_number", "title").orderBy("chapter_number")
    return rows if limit is None else rows.limit(max(1, limit))


def chapter_summary(summaries: DataFrame, number: int, max_chapter: int | None = None) -> DataFrame:
    """(book_id, chapter_number, blocked, summary) of one chapter a book; beyond the bound it is blocked, and its summary isn't told."""
    blocked = F.lit(max_chapter is not None and number > max_chapter)
    return summaries.filter(F.col("chapter_number") == number).select("book_id", "chapter_number", blocked.alias("blocked"), F.when(~blocked, F.col("summary")).alias("summary"))


def with_titles(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rows (book_id, chapter_number) with ``chapter_title``: of many rows at once, a chapter's number where it has none."""
    titles = chapters.select("book_id", "chapter_number", F.nullif(F.btrim("title"), F.lit("")).alias("__t"))
    named = F.coalesce("__t", F.concat(F.lit("第 "), "chapter_number", F.lit(" 章")))
    return rows.join(titles, ["book_id", "chapter_number"], "left").withColumn("chapter_title", named).drop("__t")


def titles_with_summaries(chapters: DataFrame, summaries: DataFrame) -> DataFrame:
    """All chapters with title and summary, "" without one."""
    s = summaries.select("book_id", "chapter_number", "summary")
    return chapters.select("book_id", "chapter_number", "title").join(s, ["book_id", "chapter_number"], "left").na.fill("", ["summary"])


def name_list(rollup: DataFrame) -> DataFrame:
    """Names of each book with ``rank``, longest first."""
    return rollup.select("book_id", "name").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("book_id").orderBy(F.length("name").desc(), "name")))


def progress_of(readers: DataFrame, chapters: DataFrame, asked: Column | None = None) -> DataFrame:
    """``readers`` (book_id, progress) with the chapter that bounds them: what is asked for, else what is stored, else the book's last chapter, else 0."""
    most = chapters.groupBy("book_id").agg(F.max("chapter_number").alias("__most"))
    chain = F.coalesce(F.lit(None) if asked is None else asked, "progress", "__most", F.lit(0))
    return readers.join(most, "book_id", "left").withColumn("bound", chain.cast("bigint")).drop("__most")


def preferences(stored: DataFrame, defaults: dict[str, str], column: str = "preferences") -> DataFrame:
    """``stored`` with the defaults for what a reader (map<string,string>; null: none) hasn't set."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.map_filter(F.coalesce(column, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    known = F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k))
    return stored.withColumn(column, F.map_concat(known, own))


def safe_id(raw: Column) -> Column:
    """An id that may name a folder."""
    return F.btrim(F.regexp_replace(raw, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))


def delete_book(spark: SparkSession, root: str, tables: list[str], book_id: str) -> dict[str, int]:
    """Removes a book's partition from each table (partitioned by book_id) under ``root``; other books' files aren't touched. Gives the rows removed; tables without the book, or absent, give 0.

    Preferences are a reader's, not a book's, so they aren't among the tables of a book.
    """
    gone = {}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(book_id)
    if not book_id or name in (".", ".."):
        raise ValueError("a book's id must name it")
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{table}/book_id={name}")
        system = path.getFileSystem(conf)
        gone[table] = 0
        if system.exists(path):
            gone[table] = spark.read.parquet(path.toString()).count()
            system.delete(path, True)
    return gone


def event_chain(events: DataFrame, keys: list[str], special: tuple[str, ...] = ("因果链", "道具流转", "伏笔/回收", "关系变化")) -> DataFrame:
    """(keys, chain, kinds): from each group's first event to its last, and which special types it has. Events come in order of chapter and window."""
    order = F.struct("chapter_number", "window_no")
    told = events.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by("summary", order).alias("a"), F.max_by("summary", order).alias("b"),
        F.min("chapter_number").alias("i"), F.max("chapter_number").alias("j"), F.collect_set("event_type").alias("types"),
    )
    one = F.concat(F.lit("第 "), "i", F.lit(" 章的关键事件是："), "a")
    more = F.concat(F.lit("事件链从第 "), "i", F.lit(" 章“"), F.substring("a", 1, 42), F.lit("”推进到第 "), "j", F.lit(" 章“"), F.substring("b", 1, 42), F.lit("”。"))
    kinds = F.filter(F.array(*map(F.lit, special)), lambda x: F.array_contains("types", x))
    head = F.when(F.size(kinds) > 0, F.concat(F.lit("命中"), F.array_join(kinds, "、"), F.lit("等阅读记忆链路。"))).otherwise("")
    return told.select(*keys, F.concat(head, F.when(F.col("n") == 1, one).otherwise(more)).alias("chain"), kinds.alias("kinds"))


def relation_fragments(pairs: DataFrame, most: int = 3) -> DataFrame:
    """(book_id, source, target, relation_type, fragments, chapters): the first fragments of each relation, and its chapters in order, once each. Only ``most`` texts a relation are gathered."""
    keys = ["book_id", "source", "target", "relation_type"]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("chapter_number", "window_no", "sentence"))
    first = pairs.withColumn("r", order).filter(F.col("r") <= most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "sentence"))), lambda x: x["sentence"]).alias("fragments"))
    return first.join(pairs.groupBy(*keys).agg(F.array_sort(F.collect_set("chapter_number")).alias("chapters")), keys)


def fragments_between(mentions: DataFrame, source: str, target: str, reach: int = 220, most: int = 3) -> DataFrame:
    """(book_id, rank, chapter_number, excerpt): mentions of ``source`` with the first mention of ``target`` within ``reach`` characters in their chapter; the first ``most`` of a book."""
    l, r = (mentions.filter(F.col("name") == x).alias(a) for x, a in ((source, "l"), (target, "r")))
    near = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("book_id", "chapter_number")] + [F.abs(F.col("l.position") - F.col("r.position")) <= reach]
    found = l.join(r, near).groupBy("l.book_id", "l.chapter_number", F.col("l.position").alias("position"), F.col("l.excerpt").alias("own")).agg(F.min_by("r.excerpt", "r.position").alias("other"))
    rows = found.withColumn("excerpt", F.when(F.contains("own", F.lit(target)), F.col("own")).otherwise(F.col("other")))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_number", "position"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("book_id", "rank", "chapter_number", "excerpt")


def relation_excerpt(content: Column, a: Column, b: Column, most: int) -> Column:
    """The text around two places, half of ``most`` characters on each side, in one line."""
    start = F.greatest(F.least(a, b) - most // 2, F.lit(0))
    end = F.least(F.length(content), F.greatest(a, b) + most // 2)
    return F.replace(T.strip(F.substring(content, (start + 1).cast("int"), (end - start).cast("int"))), F.lit("\n"), F.lit(" "))
