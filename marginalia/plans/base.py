"""Registry of queries with their SQL twins, and the driver's tables seen as books, chunks and turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The SQL twins' common tables.
CHAPTERS_SQL = "chapters AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chapter_number, doc_id, 'doc ' || doc_id AS title, text AS content FROM documents)"

#: A dictionary of frequent word forms and their aliases, shared by both sides.
NAMES = ("thha", "thnt", "eron", "ernt", "onth", "ones", "réai", "ungen")
ALIASES = (("thha", "onwh"), ("thha", "anwh"), ("ones", "onen"), ("eron", "reth"))


def query(name: str, sql: str | None = None):
    """Registers a query; whole numbers are longs in the result, as in the twin."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return add


class Tables:
    """The driver's tables, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def chapters(self) -> DataFrame:
        """Documents as chapters: a source is a book, its documents by id are the chapters."""
        ids = running(self.documents.select("doc_id", "source", F.lit(1).alias("one")), "source", "doc_id", ("one",))
        docs = self.documents.join(ids.select("doc_id", (F.col("before_one") + 1).cast("int").alias("chapter_number")), "doc_id")  # only ids are numbered
        return docs.select(F.col("source").alias("book_id"), "chapter_number", "doc_id", F.concat(F.lit("doc "), "doc_id").alias("title"), F.col("text").alias("content"))

    @property
    def chunks(self) -> DataFrame:
        c = self.chapters
        return c.select("book_id", "chapter_number", F.col("doc_id").cast("string").alias("chunk_id"), F.floor(F.col("doc_id") / 4).cast("string").alias("parent_id"), F.col("content").alias("text"))

    @property
    def names(self) -> DataFrame:
        return self.spark.createDataFrame([(n, n) for n in NAMES], "name string, surface string")

    @property
    def aliases(self) -> DataFrame:
        return self.spark.createDataFrame(list(ALIASES), "name string, alias string")

    @property
    def surfaces(self) -> DataFrame:
        return self.names.union(self.spark.createDataFrame(list(ALIASES), "name string, surface string"))


def values(rows, *names: str) -> str:
    """A SQL VALUES table."""
    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) AS v({', '.join(names)})"
