"""Operator 8: mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of rows. Block j of a source with weight w may start at floor(j/w) and must be placed before ceil((j+1)/w), in slots of
one block; earliest deadline first then keeps every source within less than one block of its target at every slot. Weights are exact fractions, so
nothing is rounded over any number of slots. The schedule is made in one run over the blocks, which the driver writes as a table in pieces
and the rows join by source and block. When a source has run out, the others begin anew with their weights scaled up.
"""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, ranked, shared_dir
from .warc import open_output

#: Rows of a block at least, and blocks of all sources at most, about: the schedule is made block by block, so blocks grow with the rows beyond that.
BLOCK_ROWS, MOST_BLOCKS = 16, 1 << 20
#: Slots that are written at once.
PIECE = 1 << 16


def parts(weights: dict) -> dict:
    """Whole numbers in exactly the proportion of the weights (floats are the fractions that they stand for). Where all weights are 0, equal ones."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights must not be negative")
    if not any(exact.values()):
        return dict.fromkeys(exact, 1)
    unit = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block, slot, release, deadline) of all blocks, slot by slot, by earliest deadline first among released blocks.

    When a source has placed its last block, the others' blocks are released from the next slot on by the weights of those that are left. Sources of weight 0 follow all others.
    """
    left, done, base = {s: n for s, n in sorted(blocks.items()) if n}, dict.fromkeys(blocks, 0), 0
    while left:
        share = {s: a for s, a in parts({s: weights[s] for s in left}).items() if a}
        total, first = sum(share.values()), {s: done[s] for s in share}
        coming, ready, slot, more = [(0, s) for s in share], [], base, True
        while more:
            while coming and coming[0][0] <= slot - base:
                _, s = heapq.heappop(coming)
                heapq.heappush(ready, (-((done[s] - first[s] + 1) * -total // share[s]), s))
            deadline, s = heapq.heappop(ready)
            j = done[s] - first[s]
            assert slot - base < deadline
            yield s, done[s], slot, base + j * total // share[s], base + deadline
            done[s], left[s], slot, more = done[s] + 1, left[s] - 1, slot + 1, left[s] > 1
            if more:
                heapq.heappush(coming, ((j + 1) * total // share[s], s))
        base, left = slot, {s: n for s, n in left.items() if n}


def written_schedule(spark: SparkSession, blocks: dict, weights: dict) -> DataFrame:
    """``schedule`` as a Parquet table in the shared folder; the driver holds one piece of it at a time."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    folder = f"{shared_dir(spark)}/mix-{uuid.uuid4().hex}"
    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at)
    kinds = pa.schema([("__s", pa.string()), ("block", pa.int64()), ("slot", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())])
    placed, piece = schedule(blocks, weights), 0
    while rows := list(itertools.islice(placed, PIECE)):
        with open_output(f"{folder}/part-{piece:06d}.parquet") as out:
            pq.write_table(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds), out)
        piece += 1
    return spark.read.schema("__s string, block long, slot long, release long, deadline long").parquet(folder)


#: Columns that ``mix`` adds, in place of columns of these names.
RESULT = ("block", "place", "slot", "release", "deadline")


def source_rows(docs: DataFrame, source: str = "source") -> dict:
    """Rows of each source, as text (null: an own source named by a zero byte). Sources are data sets, so this is a short list; their rows aren't collected."""
    return {r[0]: r[1] for r in docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("\0null")).alias("s")).count().collect()}


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", id: str = "doc_id", block_rows: int | None = None) -> DataFrame:
    """``docs`` with ``block`` (of its source), ``slot`` (of the block, gapless over all), ``place`` (in the block), ``release`` and ``deadline``.
    Order by slot, place. No row is dropped or repeated.

    ``weights`` by source; a source without one gets the square root of its rows' share, as do all if there are none.
    ``block_rows``: rows of a block; by default ``BLOCK_ROWS``, or as many as keep the number of blocks near ``MOST_BLOCKS``.
    Null sources form one source; ties and repeated rows get consecutive places; an empty table stays empty; columns named like the added ones are replaced.
    """
    counts = source_rows(docs, source)
    total = sum(counts.values())
    block_rows = block_rows or max(BLOCK_ROWS, -(-total // MOST_BLOCKS))
    weights = {s: (weights or {}).get(s, (n / total) ** 0.5) for s, n in counts.items()}
    table = written_schedule(docs.sparkSession, {s: -(-n // block_rows) for s, n in counts.items()}, weights)
    table = table.select("__s", F.col("block").alias("__block"), "slot", "release", "deadline")
    rows = ranked(docs.drop(*RESULT), [source], [F.col(id)], "__rank")
    rows = rows.withColumns({"block": F.expr(f"__rank div {block_rows}"), "place": F.expr(f"__rank % {block_rows}").cast("int"), "__key": F.coalesce(F.col(source).cast("string"), F.lit("\0null"))})
    # The schedule grows with the rows, so it is not sent whole to every executor.
    rows = rows.join(table.hint("merge"), (F.col("__key") == F.col("__s")) & (F.col("block") == F.col("__block")))
    return rows.drop("__rank", "__key", "__s", "__block")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source")).select("doc_id", "source", "block", "place", "slot", "release", "deadline")
