"""A table that a stream merges its batches into, each exactly once: latest wins, earliest wins, sums.

Each batch is merged in itself and written to a folder of its own, named by its number, so a batch that comes again replaces itself. From time to time all that is there is merged to one base,
whose name says up to which batch it goes: a batch up to there changes nothing when it comes again. A folder counts once its _SUCCESS file is there, so a write that breaks off never does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A function that gives a row a key of rows with several; merged rows can be merged again.
Merge = Callable[[DataFrame], DataFrame]


def latest(keys: list[str], order: list[str]) -> Merge:
    """The last row of each key, by ``order``, then by all other columns, so that ties don't depend on the input's order."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [*order, *sorted(c for c in rows.columns if c not in keys and c not in order)]
        return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__last")).select(*keys, "__last.*").select(*rows.columns)

    return merge


def first_seen(keys: list[str], chapter: str = "first_chapter_number", count: str = "mention_count") -> Merge:
    """The earliest chapter of each key, and the sum of its counts."""
    return lambda rows: rows.groupBy(*keys).agg(F.min(chapter).alias(chapter), F.sum(count).alias(count)).select(*rows.columns)


@dataclass
class MergeTable:
    """``path``: a folder of the table's own. ``every``: so many batches make a new base."""

    spark: SparkSession
    path: str
    merge: Merge
    every: int = 16

    def _numbers(self, kind: str) -> list[int]:
        """The complete folders ``kind=<number>``, in order."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = system.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(top, f"{kind}=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _parts(self) -> tuple[list[int], list[int]]:
        """(the base that counts, the batches behind it)."""
        base = self._numbers("base")[-1:]
        return base, [b for b in self._numbers("batch") if not base or b > base[0]]

    def read(self) -> DataFrame | None:
        """The merged table as it is, or None before the first batch."""
        base, batches = self._parts()
        paths = [*(f"{self.path}/base={b}" for b in base), *(f"{self.path}/batch={b}" for b in batches)]
        return self.merge(self.spark.read.option("basePath", self.path).option("recursiveFileLookup", "true").parquet(*paths)) if paths else None

    def add(self, rows: DataFrame, number: int) -> None:
        """Merges a batch; for ``writeStream.foreachBatch``. Batches come in order, and only the last may come again, which changes nothing."""
        base, _ = self._parts()
        if base and number <= base[0]:
            return
        self.merge(rows).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if len(self._parts()[1]) >= self.every:
            self.compact()

    def compact(self) -> None:
        """Writes a new base. What it holds is removed one base later, so that readers who began before may end."""
        base, batches = self._parts()
        if not batches:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base={batches[-1]}")
        for old in self._numbers("batch"):
            if base and old <= base[0]:
                self._remove(f"batch={old}")
        for old in self._numbers("base")[:-2]:
            self._remove(f"base={old}")

    def _remove(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
