"""Readers and writers of books, lexicons, evaluation cases and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASE = "id string, book_id string, query string, relevant_chapters array<int>, evidence_terms array<string>, max_chapter int, tags array<string>, note string"


def books(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(book_id, text): one row a text file, whole; the id is the file's name without its ending."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("book_id"), F.decode("content", encoding).alias("text"))


def book_parts(spark: SparkSession, path: str, part_chars: int = 1 << 20) -> DataFrame:
    """(book_id, part, text): UTF-8 text files in numbered parts of about ``part_chars`` characters, cut at line ends, for ``parse_chapters(..., joined="\\n")``.

    Spark reads ranges of bytes of one file in many tasks (``spark.sql.files.maxPartitionBytes``) and gives each line to the range that it begins in, so no character is cut. Parts are
    numbered by their range's first byte, so they are in order, with gaps. A line is the smallest part; an empty file has none.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"))

    def run(batches):
        at, held, size, number = None, [], 0, 0

        def part():
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1] + number], pa.int64()), pa.array(["\n".join(held)])], ["file_path", "part", "text"])

        for batch in batches:
            for line, *own in zip(*[batch.column(c).to_pylist() for c in ("value", "file_path", "start")], strict=True):
                if own != at or size >= part_chars:
                    if at is not None:
                        yield part()
                    held, size, number = [], 0, 0 if own != at else number + 1
                    at = own
                line = line.removesuffix("\r")  # the line's end may be both
                held.append(line)
                size += len(line) + 1
        if at is not None:
            yield part()

    made = lines.mapInArrow(run, "file_path string, part bigint, text string")
    return made.select(F.regexp_extract("file_path", r"([^/]+?)(\.[^./]*)?$", 1).alias("book_id"), "part", "text")


def inline_books(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "book_id string, text string")


def lexicon(lines: DataFrame) -> DataFrame:
    """(name, aliases) from lines (column value) of ``name`` or ``name|alias,alias``; ``#`` begins a comment, and commas may be full-width. A name's last line counts."""
    rows = lines.select(F.btrim("value").alias("v"), F.monotonically_increasing_id().alias("n")).filter("v <> '' and not startswith(v, '#')")
    parts = F.split("v", r"\|", 2)
    names = F.filter(F.transform(F.split(F.coalesce(F.get(parts, 1), F.lit("")), "[,，]"), lambda x: F.btrim(x)), lambda x: x != "")
    out = rows.select(F.btrim(F.get(parts, 0)).alias("name"), F.array_distinct(names).alias("aliases"), "n").filter("name <> ''")
    return out.groupBy("name").agg(F.max_by("aliases", "n").alias("aliases"))


def lexicon_file(spark: SparkSession, path: str) -> DataFrame:
    return lexicon(spark.read.text(path))


def inline_lexicon(spark: SparkSession, raw: str) -> DataFrame:
    return lexicon(spark.createDataFrame([(x,) for x in raw.splitlines()], "value string"))


def themes(defaults: DataFrame, extra: DataFrame, texts: DataFrame) -> DataFrame:
    """Default terms that occur in the texts, and all of the user's; the user's entry wins."""
    found = defaults.join(texts.select("content"), F.contains(F.col("content"), F.col("name")), "left_semi")
    return extra.unionByName(found.join(extra.select("name"), "name", "left_anti"))


def cases(spark: SparkSession, path: str, book_id: str | None = None) -> DataFrame:
    """Evaluation cases from JSON lines (``#`` comments and blank lines skipped), or one JSON file (an array, or ``{"cases": [...]}``), checked.

    Chapters are distinct. A bad line, a chapter below 1 or beyond the bound, a missing field or a repeated id raises an error when the rows are read.
    """
    if path.endswith(".json"):
        raw = spark.read.text(path, wholetext=True)
        whole = F.btrim("value")
        array = F.when(F.startswith(whole, F.lit("[")), F.from_json(whole, f"array<struct<{_struct()}>>", {"mode": "FAILFAST"})).otherwise(F.from_json(whole, f"struct<cases:array<struct<{_struct()}>>>", {"mode": "FAILFAST"})["cases"])
        rows = raw.select(F.inline(array))
    else:
        lines = spark.read.text(path).filter("btrim(value) <> '' and not startswith(btrim(value), '#')")
        rows = lines.select(F.from_json("value", CASE, {"mode": "FAILFAST"}).alias("c")).select("c.*")
    if book_id is not None:
        rows = rows.withColumn("book_id", F.lit(book_id))
    bad = (
        F.col("id").isNull() | F.col("book_id").isNull() | (F.coalesce(F.btrim("query"), F.lit("")) == "") | (F.coalesce(F.size("relevant_chapters"), F.lit(0)) < 1)
        | F.exists("relevant_chapters", lambda c: (c < 1) | (c > F.coalesce("max_chapter", F.lit(2**31 - 1))))
    )
    rows = rows.withColumn("relevant_chapters", F.array_distinct(F.when(bad, F.raise_error(F.concat(F.lit("bad case: "), F.coalesce("id", F.lit("?"))))).otherwise(F.col("relevant_chapters"))))
    twice = F.count("*").over(Window.partitionBy("id"))
    return rows.withColumn("id", F.when(twice > 1, F.raise_error(F.concat(F.lit("repeated id: "), "id"))).otherwise(F.col("id")))


def _struct() -> str:
    return CASE.replace(" string", ":string").replace(" array", ":array").replace(" int", ":int")


def write_vectors(rows: DataFrame, path: str) -> None:
    """(book_id, chunk_id, embedding) by book."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def vectors(spark: SparkSession, path: str, book_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("book_id") == book_id)


def vector_info(rows: DataFrame) -> DataFrame:
    """(book_id, chunk_count, dimension)."""
    return rows.groupBy("book_id").agg(F.count("*").alias("chunk_count"), F.max(F.size("embedding")).alias("dimension"))


def embed(chunks: DataFrame, model, text: str = "text") -> DataFrame:
    """Adds ``embedding`` (array<float>) of length 1; ``model()`` gives a function from a list of texts to vectors, once a task."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model()
        for b in batches:
            v = np.asarray(m(b.tolist()), np.float32).reshape(len(b), -1)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(norm == 0, 1, norm)))

    return chunks.withColumn("embedding", encode(text))


def stage_table(spark: SparkSession, root: str, stage: str) -> DataFrame | None:
    """A finished stage's table, or None if it isn't there or was cut off (no _SUCCESS)."""
    path = f"{root.rstrip('/')}/{stage}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else None


def save_stage(rows: DataFrame, root: str, stage: str) -> None:
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{stage}")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))
