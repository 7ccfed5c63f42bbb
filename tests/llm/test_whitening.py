"""Exact polynomials against definitions, whitened rows against plain doubles, equal roots, deficient ranks and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import polynomial as P
from hearthline.llm import whitening as W


def whole(m):
    return [[int(v) for v in r] for r in m]


def exact(m):
    """Characteristic polynomial by the Faddeev-LeVerrier recurrence in Python integers, constant term first."""
    d = len(m)
    a, out, c = np.array(m, object), [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        c = a.dot(c) + out[-1] * np.eye(d, dtype=int).astype(object)
        out.append(-int(a.dot(c).trace()) // k)
    return out[::-1]


def polynomial(m):
    trace = sum(m[i][i] for i in range(len(m)))
    primes = P.primes_below(2 ** 31, P.coefficient_bits(trace, len(m)))
    return P.combine(P.residues(m, primes), primes)


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 1), (5, 5), (9, 4), (14, 14)])
def test_polynomial(d, rank):
    b = np.random.default_rng(d).integers(-10 ** 6, 10 ** 6, (d, rank)).astype(object)
    m = whole(b.dot(b.T))
    assert polynomial(m) == exact(m)


def test_polynomial_with_zero_columns():
    m = whole(np.array([[4, 0, 0, 1], [0, 0, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]], object))
    assert polynomial(m) == exact(m)


def test_roots_close_and_equal():
    near = 10 ** 12
    m = whole(np.diag(np.array([near, near + 1, 7, 7, 7, 0], object)))
    roots, scale = P.largest_roots(polynomial(m), 2 * near + 22, 6)
    assert [(round(r / 2 ** scale), n) for r, n in roots] == [(near + 1, 1), (near, 1), (7, 3)]
    assert abs(roots[1][0] - (near << scale)) <= 1
    v = P.null_space(m, roots[2][0], scale, 3)
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-15) and np.allclose(v[:, [0, 1, 5]], 0, atol=1e-15)
    assert np.allclose(P.null_space(m, roots[0][0], scale, 1), [[0, 1, 0, 0, 0, 0]], atol=1e-15)


def test_products_are_exact():
    draw = np.random.default_rng(3)
    for top in (10 ** 3, 10 ** 8, 2 ** 50):
        y = draw.integers(-top, top, (700, 3))
        assert (W.products(y) == y.astype(object).T.dot(y.astype(object))).all()


def check(rows, got, wanted=8):
    """Rows of one length against doubles; values of close roots are compared through their covariance only."""
    x = np.array([np.floor(np.array(v, np.float64) * 1024) for _, v in rows])
    n, exact_x = len(x), x.astype(np.int64).astype(object)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(wanted, int((values > 1e-9 * values[0]).sum())) if values[0] > 0 else 0
    assert len(got) == n * rank
    deviation = sorted(int(v) for v in ((exact_x * n - exact_x.sum(axis=0)) ** 2).sum(axis=1))
    assert sorted(int(r.deviation) for r in got if r.component == 1) == (deviation if rank else [])
    for c in range(1, rank + 1):
        mine = sorted((r for r in got if r.component == c), key=lambda r: str(r[0]))
        assert all(abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 and r.n == n for r in mine)
        white = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        order = sorted(range(n), key=lambda i: str(rows[i][0]))
        found = np.array([r.whitened for r in mine])
        assert min(abs(found - white[order]).max(), abs(found + white[order]).max()) < 1e-6


@pytest.mark.parametrize("d, n", [(3, 50), (12, 300), (20, 6)])
def test_whitened_rows(spark, d, n):
    draw = np.random.default_rng(d)
    mix = draw.normal(size=(d, d))
    rows = [(i, [float(v) for v in draw.normal(size=d) @ mix + 3]) for i in range(n)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    check(rows, W.whiten(table).collect())


def test_odd_rows(spark):
    draw = np.random.default_rng(2)
    good = [(i, [float(v) for v in draw.normal(size=4)]) for i in range(30)] + [(None, [1.0, 2.0, 3.0, 4.0])] + [(100, [0.5] * 4), (101, [0.5] * 4)]
    other = [(200 + i, [float(v) for v in draw.normal(size=2)]) for i in range(9)]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1e300] * 4)]
    table = spark.createDataFrame([(i, v, "a", 1, 2.0) for i, v in good + other + bad], "vec_id long, embedding array<double>, id string, y int, white double")
    got = W.whiten(table).collect()
    check(good, [r for r in got if r.n == len(good)])
    check(other, [r for r in got if r.n == len(other)])
    assert {r.n for r in got} == {len(good), len(other)}


def test_long_entries_stay_exact(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(v) for v in draw.integers(-2 ** 36, 2 ** 36, 3)]) for i in range(40)]
    check(rows, W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_more_than_eight_equal_roots(spark):
    """Ten equal variances: any eight orthonormal directions of their space are components."""
    rows = [(2 * i + s, [float(7 * (2 * s - 1)) if k == i else 0.0 for k in range(10)]) for i in range(10) for s in (0, 1)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.count() == 20 * 8 and {round(r.explained, 12) for r in got.select(F.col("explained")).distinct().collect()} == {0.1}
    assert got.first().identity_error < 1e-9
