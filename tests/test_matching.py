"""Dictionary matching against str.find, name by name."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.operators import matching, mentions


def brute(text, surfaces):
    return sorted((s, m.start()) for s in surfaces for m in re.finditer(re.escape(s), text))


def made_up(seed, names, texts):
    rng = random.Random(seed)
    surfaces = {"".join(rng.choices("ab甲乙", k=rng.randint(1, 5))) for _ in range(names)}
    return surfaces, ["".join(rng.choices("ab甲乙 \n", k=rng.randint(0, 60))) for _ in range(texts)]


@pytest.mark.parametrize("slice_chars", [1 << 20, 40])
def test_occurrences_equal_find(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(matching, "SLICE_CHARS", slice_chars)
    surfaces, texts = made_up(3, 60, 80)
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None), (-2, "")], "id long, t string").repartition(3)
    names = spark.createDataFrame([(s, s) for s in surfaces] + [("none", ""), ("twice", next(iter(surfaces)))], "name string, surface string")
    got = {}
    for r in matching.occurrences(df, "t", names).collect():
        got.setdefault(r.id, []).append((r.surface, r.position))
    assert {k: sorted(v) for k, v in got.items()} == {i: b for i, t in enumerate(texts) if (b := brute(t, surfaces))}
    rows = matching.contained(df, "t", names).collect()
    assert {r.id: r.names for r in rows} == {i: sorted({s for s in surfaces if t and s in t}) for i, t in [*enumerate(texts), (-1, ""), (-2, "")]}


def test_overlapping_and_nested_names(spark):
    chapters = spark.createDataFrame([("b", 1, "aaaa abab 😀ab\nab"), ("b", 2, "aa"), ("c", 1, None)], "book_id string, chapter_number int, content string")
    names = spark.createDataFrame([("x", "aa"), ("x", "ab"), ("y", "aab"), ("z", "a")], "name string, surface string")
    rows = mentions.mentions(chapters, names, pad=2).collect()
    assert sorted((r.name, r.chapter_number, r.position, r.surface, r.mention_no) for r in rows if r.name != "z") == [
        ("x", 1, 0, "aa", 1), ("x", 1, 2, "aa", 2), ("x", 1, 5, "ab", 3), ("x", 1, 7, "ab", 4), ("x", 1, 11, "ab", 5), ("x", 1, 14, "ab", 6), ("x", 2, 0, "aa", 7),
    ]
    assert sum(r.name == "z" for r in rows) == 10
    assert next(r.excerpt for r in rows if r.position == 11) == "b 😀ab a"[1:].strip()


def test_no_names_and_no_texts(spark):
    chapters = spark.createDataFrame([("b", 1, "aa")], "book_id string, chapter_number int, content string")
    names = spark.createDataFrame([("x", "aa")], "name string, surface string")
    assert mentions.mentions(chapters, names.limit(0)).collect() == []
    assert mentions.mentions(chapters.limit(0), names).collect() == []
    assert [r.names for r in matching.contained(chapters, "content", names.limit(0)).collect()] == [[]]


def test_many_names_are_one_pass_without_a_loop_join(spark):
    chapters = spark.createDataFrame([("b", k, f"w{k} w{k + 7} x" * 3) for k in range(300)], "book_id string, chapter_number int, content string")
    names = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("name")).select("name", F.col("name").alias("surface"))
    found = mentions.mentions(chapters, names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r.chapter_number, r.surface, r.position) for r in found.collect())
    want = sorted((k, s, p) for k in range(300) for s, p in brute(f"w{k} w{k + 7} x" * 3, {f"w{str(n)[:i]}" for n in (k, k + 7) for i in range(1, 4)}))
    assert got == want


def test_texts_are_searched_in_portions(spark):
    """A batch of many long texts is worked on, and leaves, some texts at a time."""
    from marginalia.operators import batches

    assert list(batches.portions(pa.array(["ab", None, "cde", "f" * 9, "", "g"]), 5)) == [(0, 3), (3, 4), (4, 6)]
    assert list(batches.portions(pa.array([], pa.string()))) == []
    assert list(batches.portions(pa.array(["xx", "ab", "cd", "e"]).slice(1), 2)) == [(0, 1), (1, 2), (2, 3)]
    rows = [(i, ("ab" * 40_000 + "甲") if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    names = spark.createDataFrame([("甲",), ("bab甲",)], "surface string")
    got = sorted((r.id, r.surface, r.position) for r in matching.occurrences(df, "text", names).select("id", "surface", "position").collect())
    assert got == sorted((i, s, 80_000 - len(s) + 1) for i, t in rows if t for s in ("甲", "bab甲"))


def test_grams_are_cut_once_a_distinct_run(spark):
    texts = spark.createDataFrame([("甲乙丙丁 甲乙丙丁",)] * 500 + [("甲乙丙丁戊甲乙",)] * 3 + [(None,), ("甲乙",)], "content string")
    counts = mentions.ngram_counts(texts, least=3)
    assert {r.gram: r.n for r in counts.collect()} == {"甲乙": 1006, "乙丙": 1003, "丙丁": 1003, "丁戊": 3, "戊甲": 3, "甲乙丙": 1003, "乙丙丁": 1003, "丙丁戊": 3, "丁戊甲": 3, "戊甲乙": 3, "甲乙丙丁": 1003, "乙丙丁戊": 3, "丙丁戊甲": 3, "丁戊甲乙": 3}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.rindex("Aggregate [") > plan.index("Generate explode(concat")


def test_a_filter_on_names_searches_no_text_again(spark, small):
    from marginalia.plans import QUERIES

    for name, times in (("relation_stages", 1), ("event_sentences", 1)):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == times, name
