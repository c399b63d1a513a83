"""What the operators share: the cluster's scratch folder, null rules, and exact ranks without hot tasks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of characters other than these six ASCII white space characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset a local session, as in tests, gets a temporary one; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads need no lineage and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(batches, column: str):
    """(key, its batches) for each run of equal keys in sorted batches; one batch is held at a time."""
    batches, batch = iter(batches), None

    def more() -> bool:
        nonlocal batch
        while batch is None or not batch.num_rows:
            batch = next(batches, None)
            if batch is None:
                return False
        return True

    def own(key):
        nonlocal batch
        while more():
            other = np.flatnonzero(batch.column(column).to_numpy() != key)
            n = int(other[0]) if len(other) else batch.num_rows
            if not n:
                return
            part, batch = batch.slice(0, n), batch.slice(n)
            yield part

    while more():
        key = batch.column(column)[0].as_py()
        group = own(key)
        yield key, group
        for _ in group:  # what the caller left unread
            pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row; a plain reference inside a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spaced(text: Column) -> Column:
    """A text (null: empty) with each of the six white space characters as one blank. Line ends are by far the commonest, and ``replace`` is much cheaper than ``translate``."""
    t = F.coalesce(text, F.lit(""))
    rare = F.contains(t, F.lit("\t")) | F.contains(t, F.lit("\r")) | F.contains(t, F.lit("\x0b")) | F.contains(t, F.lit("\x0c"))
    return F.when(rare, F.translate(t, "\n\t\x0b\x0c\r", "     ")).otherwise(F.replace(t, F.lit("\n"), F.lit(" ")))


def split_words(blanks: Column) -> Column:
    """The words of a text whose white space is blanks only."""
    odd = F.contains(blanks, F.lit("  ")) | F.startswith(blanks, F.lit(" ")) | F.endswith(blanks, F.lit(" ")) | (blanks == "")
    pieces = F.split(blanks, " ")
    return F.when(odd, F.filter(pieces, lambda w: w != "")).otherwise(pieces)


def words_of(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    return let(spaced(text), split_words)


def ranked(rows: DataFrame, by: list[str], order: list[Column], into: str, spread: int = 4096) -> DataFrame:
    """Adds ``into``: the exact 0-based rank inside each ``by`` group, in the order of a hash of ``order``, then ``order`` itself.

    A window over a whole group would put a hot group into one task. Hash order lets a group be cut at fixed hash
    values into ``spread`` pieces: ranks are made inside pieces, and the counts of the pieces before are added. The pieces' counts are
    ``spread`` rows a group, and both sides are dealt by (group, piece), so the rows move once.
    Equal rows get distinct, consecutive ranks. Null keys form a group of their own.
    """
    key, piece = f"__h_{into}", f"__p_{into}"
    cut = rows.withColumn(key, F.xxhash64(*order)).withColumn(piece, F.pmod(F.shiftright(key, 32), F.lit(spread)).cast("int"))
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in by]
    for i, g in enumerate(groups):
        cut = cut.withColumn(f"__g{i}_{into}", g)
    names = [f"__g{i}_{into}" for i in range(len(by))]
    counts = cut.groupBy(*names, piece).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*names).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*names, piece, before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*names, piece).orderBy(key, *order)) - 1
    out = cut.withColumn(into, inside.cast("long")).join(starts, [*names, piece])
    return out.withColumn(into, F.col(into) + F.col("__before")).drop("__before", key, piece, *names)
