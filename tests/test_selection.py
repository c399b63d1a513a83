"""Nearest ranks, nearest vectors and case-blind terms against plain Python."""

import math
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.operators import evaluate, selection, vectors


def ranks(values, q):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    return v[max(1, math.ceil(round(len(v) * q, 9))) - 1]


def test_nearest_ranks_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(selection, "LEAF", 50)
    rng = random.Random(2)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(3000)] + [1e300, -1e300, 5e-324, 0.0],
        "same": [2.5] * 400, "few": [3.0, 1.0], "one": [7.0], "odd": [float("inf"), float("-inf"), float("nan"), 1.0, 2.0], "nan": [float("nan")] * 3, None: [1.0, 2.0, 3.0, 4.0],
        "close": [1.0 + k * 2**-52 for k in range(40)], "huge": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(300)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "all": 1.0}
    got = {r.k: r for r in selection.nearest_ranks(df, "k", "v", shares).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, q in shares.items():
            assert repr(got[k][name] + 0.0) == repr(ranks(values, q) + 0.0), (k, name)


def test_nearest_ranks_of_whole_numbers(spark):
    values = [2**60 + k for k in range(50)] + [5, 5, 5]
    got = selection.nearest_ranks(spark.createDataFrame([(1, v) for v in values], "k int, v bigint"), "k", "v", {"m": 0.5}).collect()
    assert [tuple(r) for r in got] == [(1, sorted(values)[math.ceil(len(values) / 2) - 1])]


@pytest.mark.parametrize("numbers", [1 << 22, 40])
def test_nearest_vectors_of_many_questions(spark, monkeypatch, numbers):
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(vectors, "ROWS", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 5)).round(1)
    x[40:70] = x[3]  # copies
    x[80] = 0
    rows = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(x.tolist())] + [("null", None), ("short", [1.0])], "chunk_id string, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(x[:30].tolist())] + [(99, None), (98, [0.0] * 5)], "query_id long, embedding array<double>")
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    want = set()
    for q, v in [*enumerate(x[:30]), (98, np.zeros(5))]:
        s = np.floor(unit(v[None]) @ unit(x).T * 1e6 + 0.5)[0] / 1e6
        best = sorted(((-s[i], f"c{i}") for i in range(120)))[:6]
        want |= {(q, c, -t, r + 1) for r, (t, c) in enumerate(best)}
    got = {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in vectors.nearest(rows, asked, 6).collect()}
    same = lambda rows: {(int(q), c, round(float(s), 5), int(r)) for q, c, s, r in rows}
    assert same(got) == same(want)
    assert vectors.nearest(rows, asked.limit(0)).collect() == []


def test_coverage_of_terms_is_blind_to_case(spark):
    cases = spark.createDataFrame([(1, ["STRASSE", "ὈΔΥΣΣΕΎΣ", "Istanbul", " ", "istanbul "]), (2, []), (3, ["铜镜", "nothing"]), (4, ["x"])], "case_id int, evidence_terms array<string>")
    hits = spark.createDataFrame([("m", 1, 1, "die Straße"), ("m", 1, 2, "ὀδυσσεύς"), ("m", 1, 9, "ISTANBUL"), ("m", 3, 1, "一面铜镜"), ("m", 2, 1, "x")], "method string, case_id int, rank int, text string")
    got = {r.case_id: r.coverage for r in evaluate.coverage(cases, hits).collect()}
    assert got[2] is None and got[3] == 0.5 and got[4] == 0
    # ß is ss only by full folding, which the collation has; both sigmas are one letter to it. The ninth hit is beyond the first four, so neither Istanbul is there.
    assert got[1] == pytest.approx(2 / 4)


def test_folded_case_is_pythons(spark):
    """For every letter: the same form just where ``casefold`` is the same, and forms of folded letters are one letter each, so that one text has another by these forms where it does by those."""
    from collections import defaultdict

    from marginalia.functions.text import case_folded

    letters = [c for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(c := chr(i)) != "Cn"]
    texts = [*letters, "x\u0131y\u0131", "\u0131", "", "DIE STRA\u1e9eE", "ΣΑΣ σας"]
    table = pa.table({"c": texts, "f": [c.casefold() for c in texts]})
    rows = spark.createDataFrame(table).select("c", "f", case_folded(F.col("c")).alias("x"), case_folded(F.col("f")).alias("y")).collect()
    assert [r.c for r in rows if r.x != r.y] == []
    same = defaultdict(set)
    for r in rows:
        same[r.x].add(r.f)
        if r.f == r.c and len(r.c) == 1:
            assert len(r.x) == 1
    assert [v for v in same.values() if len(v) > 1] == []


def test_reports_count_errors_and_violations(spark):
    results = spark.createDataFrame([("m", 1, 1.0, 1.0, True, None, 0.5, 0), ("m", 2, 0.0, 0.0, False, "broken", None, 2)], "method string, case_id int, reciprocal_rank double, recall double, top1 boolean, error string, coverage double, violations int")
    r = evaluate.report(results).first()
    assert (r.total_cases, r.top1_accuracy, r.errors, r.violations, r.term_coverage) == (2, 0.5, 1, 2, 0.5)
    assert evaluate.rendered(evaluate.report(results)).first().line == "m：2 题，Top1 50.0%，Recall@K 50.0%，MRR 0.500，证据词 50.0%，错误 1，越界 2"
    cases = spark.createDataFrame([(1, 5), (2, None)], "case_id int, max_chapter int")
    hits = spark.createDataFrame([("m", 1, 1, 5), ("m", 1, 2, 6), ("m", 2, 1, 99)], "method string, case_id int, rank int, chapter_number int")
    assert sorted(map(tuple, evaluate.violations(cases, hits).collect())) == [("m", 1, 1), ("m", 2, 0)]


def test_a_task_holds_the_best_of_its_questions_only():
    """2,000 questions to 6,000 rows would be 96 MB of scores; a task keeps 10 of each, and works on a bounded tile."""
    import tracemalloc
    from types import SimpleNamespace

    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(6000, 8)), vectors._unit(rng.normal(size=(2000, 8)))
    x[100:400] = x[7]  # copies, so that scores tie
    batch = pa.RecordBatch.from_arrays([pa.array([f"c{i}" for i in range(6000)]), pa.array(x.tolist(), pa.list_(pa.float64()))], ["chunk_id", "v"])
    run = vectors._best(SimpleNamespace(value=(np.arange(2000).astype(object), q)), 8, 10, "bigint")
    tracemalloc.start()
    got = [r for b in run([batch]) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 20000 and peak < 60e6
    s = np.floor(q[5] @ vectors._unit(x).T * 1e6 + 0.5) / 1e6
    assert [(r["chunk_id"], r["score"]) for r in got if r["query_id"] == 5] == [(c, -t) for t, c in sorted(zip(-s, (f"c{i}" for i in range(6000))))[:10]]


def test_pairs_of_parts_take_as_many_tasks_as_there_are_lines(spark, small, monkeypatch):
    from marginalia.plans import QUERIES, logs

    few = QUERIES["part_pairs"](spark, small).collect()
    monkeypatch.setattr(logs, "LINES", 100)
    many = QUERIES["part_pairs"](spark, small)
    assert many.rdd.getNumPartitions() >= 60
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few))
