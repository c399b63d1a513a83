"""Many names in many texts at once: an Aho-Corasick automaton over Arrow batches, so that the cost of a text doesn't depend on the number of names.

A dictionary goes to the tasks by broadcast, in slices of a checked size; a dictionary of one slice, the usual case, is one pass over the texts, and a larger one is a pass for each
slice, so that no task ever holds more than a slice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import portions

#: Characters of the surfaces of a slice, about.
SLICE_CHARS = 1 << 20

_known: dict[str, ahocorasick.Automaton] = {}


def slices(names: DataFrame) -> Iterator[list[str]]:
    """The distinct surfaces of a dictionary (column surface) that aren't empty, in slices of about ``SLICE_CHARS`` characters, dealt by hash. Only one is on the driver at a time."""
    some = names.select("surface").filter("surface <> ''").distinct()
    total = some.agg(F.coalesce(F.sum(F.length("surface")), F.lit(0))).first()[0]
    n = max(1, -(-total // SLICE_CHARS))
    for i in range(n):
        yield sorted(r.surface for r in (some if n == 1 else some.filter(F.pmod(F.xxhash64("surface"), F.lit(n)) == i)).collect())


def compiled(key: str, surfaces: list[str]) -> ahocorasick.Automaton:
    """The automaton of a slice, built once in a Python worker; the worker keeps the last few."""
    if key not in _known:
        if len(_known) > 3:
            _known.clear()
        a = ahocorasick.Automaton()
        for s in surfaces:
            a.add_word(s, s)
        a.make_automaton()
        _known[key] = a
    return _known[key]


def places(a: ahocorasick.Automaton, text: str) -> list[tuple[str, int]]:
    """(surface, 0-based place) of the occurrences of all surfaces, those of one surface not overlapping each other, from the left; those of different ones may."""
    found, free = [], {}
    for end, surface in a.iter(text):
        start = end + 1 - len(surface)
        if start >= free.get(surface, 0):
            free[surface] = end + 1
            found.append((surface, start))
    return found


def _found(surfaces: list[str], spark) -> Column:
    """A function of a text column: array<struct<surface, position>>."""
    known, key = spark.sparkContext.broadcast(surfaces), uuid.uuid4().hex  # a slice
    kind = pa.list_(pa.struct([("surface", pa.string()), ("position", pa.int32())]))

    @F.arrow_udf("array<struct<surface:string,position:int>>")
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if not known.value:
                yield pa.array([[]] * len(column), kind)
                continue
            a = compiled(key, known.value)
            for i, j in portions(column):
                ends, names, at = [0], [], []
                for text in column.slice(i, j - i).to_pylist():
                    for surface, start in places(a, text) if text else ():
                        names.append(surface)
                        at.append(start)
                    ends.append(len(at))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.int32())], names=["surface", "position"])).cast(kind)

    return find.asNondeterministic()  # or filters on what is found would search each text again


def occurrences(rows: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """``rows`` with surface and position (0-based), a row for each occurrence of a surface of ``names`` in ``text``; null texts have none. Texts aren't shuffled."""
    out = None
    for surfaces in slices(names):
        found = _found(surfaces, rows.sparkSession)(F.col(text))
        part = rows.withColumn("__found", found).select(*[f"`{c}`" for c in rows.columns], F.inline("__found").alias("surface", "position"))
        out = part if out is None else out.unionByName(part)
    return out


def contained(rows: DataFrame, text: str, names: DataFrame, into: str = "names") -> DataFrame:
    """``rows`` with ``into``: the distinct surfaces of ``names`` that ``text`` has, sorted. With a dictionary of several slices, equal rows become one."""
    parts = list(slices(names))
    spark = rows.sparkSession
    of = lambda s: F.array_sort(F.array_distinct(_found(s, spark)(F.col(text))["surface"]))
    if len(parts) == 1:
        return rows.withColumn(into, of(parts[0]))
    each = [rows.withColumn(into, of(s)) for s in parts]
    both = each[0]
    for other in each[1:]:
        both = both.unionByName(other)
    keys = [f"`{c}`" for c in rows.columns]
    return both.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(into))).alias(into))
