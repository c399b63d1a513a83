"""Whitening against numpy's eigenvalues and exact Python numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import whitening


def brute(vectors, components=8):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    k = min(components, x.shape[1])
    return n, deviation, y @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 7, 24):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        want = np.sort(10.0 ** rng.uniform(-6, 4, d))[::-1]
        values, vectors = whitening.jacobi(q * want @ q.T)
        np.testing.assert_allclose(values, want, rtol=1e-5)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
    # A graded matrix keeps its small eigenvalues to full relative accuracy.
    scale = np.diag(10.0 ** -np.arange(6.0))
    near = scale @ (np.eye(6) + 0.1) @ scale
    exact = [float(x) for x in np.linalg.eigvalsh(near.astype(np.longdouble).astype(np.float64))][::-1]
    values, vectors = whitening.jacobi(near)
    np.testing.assert_allclose(values[:3], exact[:3], rtol=1e-9)
    np.testing.assert_allclose(np.prod(values), np.linalg.det(np.eye(6) + 0.1) * 1e-30, rtol=1e-10)
    assert (whitening.jacobi(np.zeros((3, 3)))[0] == 0).all()


def test_query_equals_numpy(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in table], [r.embedding for r in table]
    n, deviation, white, explained = brute(vectors)
    rows = whitening.op12_whitening(spark, small).collect()
    assert len(rows) == 8 * n and {r.n for r in rows} == {n}
    at = {v: i for i, v in enumerate(ids)}
    got = np.zeros((n, 8))
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]]
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        assert 0 <= r.identity_error < 1e-9
    sign = np.sign((got * white).sum(0))
    np.testing.assert_allclose(got * sign, white, atol=1e-8)


ROWS = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, []), (7, [1.0, 2.0]), (None, [3.0, 1.0, -2.0]), (8, [0.5, 0.25, -7.0]), (9, [2.0**53, 0.0, 0.0])]


def test_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "vec_id long, embedding array<double>").withColumns({"n": F.lit("clash"), "whitened": F.lit("clash"), "more": F.lit("kept")})
    out = whitening.whitened(df)
    assert sorted(out.columns) == sorted(["vec_id", "more", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    rows = out.collect()
    left = [v for _, v in (ROWS[0], ROWS[1], ROWS[8], ROWS[9])]
    n, deviation, white, explained = brute(left)
    assert len(rows) == 3 * n and {r.more for r in rows} == {"kept"}
    assert sorted((r.vec_id or 0, r.deviation) for r in rows) == sorted((i, d) for i, d in zip((1, 1, 0, 8), deviation, strict=True) for _ in range(3))
    for r in rows:
        if r.component < 3:  # four rows, two of them alike, span two axes
            assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-6)
            assert any(math.isclose(abs(r.whitened), abs(w), abs_tol=1e-6) for w in white[:, r.component - 1])
        else:
            assert r.whitened == r.explained == 0
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.collect() == []
    assert set(out.columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_one_row_has_no_variance(spark):
    rows = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(rows)] == [(1, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]


def test_deviations_beyond_a_long_are_null(spark):
    # Sums of squares around 2**63, sums beyond a double's whole numbers, and sums beyond a long.
    side = int(math.isqrt(2**63))
    cases = {0: [side - 1, 0], 1: [side + 1, 0], 2: [3, 4], 3: [2**61, 0]}
    model = whitening.Whitening(1, [0, 0])
    got = model.deviation(np.array(list(cases.values()), np.int64)).to_pylist()
    assert got == [(side - 1) ** 2, None, 25, None]
    model = whitening.Whitening(3, [3 * 2**61 + 1, 2**63 + 2])
    assert model.deviation(np.array([[2**61, (2**63 + 2) // 3], [2**61, 1]], np.int64)).to_pylist() == [2, None]
