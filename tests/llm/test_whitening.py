"""Whitening against exact integers and LAPACK, and the edge cases."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from prefloom.llm import whitening
from prefloom.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_components_equal_lapack(d):
    r = np.random.default_rng(d)
    a = r.normal(size=(d, d)) * np.exp(2 * r.normal(size=d))
    v = a @ a.T
    e, x = whitening.spectral_components(v)
    want = np.linalg.eigvalsh(v)[::-1]
    assert np.abs(e - want).max() <= 1e-13 * want[0]
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-12
    assert np.abs(v @ x - x * e).max() <= 1e-13 * want[0]


@pytest.mark.parametrize("v", [np.eye(4), np.zeros((3, 3)), np.ones((6, 6)), np.diag([1.0, 1, 2, 2, 2]), np.diag([5.0, 5, 5, 1e-12, 0])])
def test_equal_and_zero_eigenvalues(v):
    e, x = whitening.spectral_components(v)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], atol=1e-14)
    assert np.allclose(x.T @ x, np.eye(len(v)), atol=1e-14)
    assert np.allclose(v @ x, x * e, atol=1e-14)


def test_whole_table_against_brute_force(spark):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF001}/embeddings.parquet'").fetchall()
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    y = z.astype(float) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    white = y @ u / np.sqrt(e)
    at = {i: k for k, (i, _) in enumerate(rows)}
    got = QUERIES["op12_whitening"](spark, SF001).collect()
    assert len(got) == 32 * n
    table = np.zeros((n, 32))
    for r in got:
        table[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int((z[at[r.vec_id]] ** 2).sum())
        assert abs(r.explained - e[r.component - 1] / np.trace(v)) <= 1e-10 * r.explained
        assert r.identity_error < 1e-9
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table - white * signs).max() < 1e-8
    assert np.abs(np.cov(table.T, bias=True) - np.eye(32)).max() < 1e-9


def test_edge_rows(spark):
    bad = [(1, None, 0), (2, [], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [1.0], 0), (7, [1e30, 0.0], 0)]
    good = [(10, [0.5, 1.0], 0), (10, [0.5, 1.0], 0), (None, [-0.5, 3.0], 1), (11, [0.25, -2.0], 2)]
    got = whitening.whiten(spark.createDataFrame(bad + good, SCHEMA)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["10", "10", "11", "None"] and {r.n for r in got} == {4}
    w = np.array([r.whitened for r in got])
    assert w.shape == (4, 2) and np.allclose(w.T @ w / 4, np.eye(2))
    assert whitening.component_rows(whitening.whiten(spark.createDataFrame(bad[:5], SCHEMA))).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0)], SCHEMA)).first()
    assert one.whitened == [None, None] and one.deviation == 0 and one.identity_error == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 7.0], 0) for i in range(5)], SCHEMA)).collect()
    assert all(r.whitened[1] is None and r.whitened[0] is not None for r in flat)


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i * i)], i, "x") for i in range(6)], "vec_id long, embedding array<double>, n int, WHITENED string")
    out = whitening.whiten(rows)
    assert out.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.component_rows(out).count() == 12


def test_large_values_stay_exact(spark):
    big = [2.0**50, -(2.0**51), 3.0 * 2**49, 5.0]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame([(i, [v, 1.0], 0) for i, v in enumerate(big)], "vec_id long, embedding array<double>, label int")).collect()}
    x = [math.floor(64 * Fraction(v)) + 1_000_000 for v in big]
    for i, v in enumerate(x):
        assert int(got[i].deviation) == (4 * v - sum(x)) ** 2


def test_layout_does_not_matter(spark):
    t = spark.read.parquet(f"{SF001}/embeddings.parquet")
    a, b = ({r.vec_id: r.whitened for r in whitening.whiten(t.repartition(p)).collect()} for p in (1, 7))
    assert max(np.abs(np.array(a[i]) - np.array(b[i])).max() for i in a) < 1e-8
