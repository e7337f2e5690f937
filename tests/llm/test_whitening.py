"""Eigenpairs against numpy's, the whole operator against a plain version with exact whole numbers."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.llm.whitening import counts_below, fit_whitening, identity_error, leading_eigenpairs, op11_embedding_whitening, tridiagonal, whiten

SF = "/root/testdata/sf0.001"


def brute(rows, k=4):
    """{id: (deviation, whitened)}, eigenvalues' shares and n, with numpy's eigenvectors."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, tuple(v) + (0,) * (width - len(v))) for i, v in good]
    fit = sorted({v for _, v in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums, float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array(v, float) - np.array(sums, float) / n) @ axes / np.sqrt(np.maximum(values, 1e-300))) for i, v in good]
    return out, values / np.trace(centred.T @ centred / n), n


@pytest.mark.parametrize("seed", range(12))
def test_eigenpairs(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 50))
    a = r.normal(size=(n, n))
    if seed % 4 == 0:  # many equal eigenvalues, nothing beside the diagonal
        v = np.diag(r.integers(0, 3, n)).astype(float)
    elif seed % 4 == 1:  # a cluster
        q = np.linalg.qr(a)[0]
        v = q @ np.diag([5.0 + 1e-9 * k if k < 6 else 1.0 for k in range(n)]) @ q.T
    elif seed % 4 == 2:  # of low rank
        v = a[:, :2] @ a[:, :2].T
    else:
        v = a @ a.T
    v = (v + v.T) / 2
    values, axes = leading_eigenpairs(v, 4)
    norm = max(1.0, np.abs(v).max())
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:4], atol=1e-12 * norm)
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-12) and np.abs(v @ axes - axes * values).max() < 1e-11 * norm


def test_sturm_counts():
    v = np.cov(np.random.default_rng(1).normal(size=(20, 60)))
    diagonal, beside, _ = tridiagonal(v)
    real = np.linalg.eigvalsh(v)
    at = np.linspace(real[0] - 1, real[-1] + 1, 41)
    assert counts_below(diagonal, beside, at).tolist() == [int((real < x).sum()) for x in at]


def test_query(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    want, shares, n = brute(rows)
    got = op11_embedding_whitening(spark, SF).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(4):
        sign = 1 if by[rows[0][0], k + 1].whitened * want[0][2][k] > 0 else -1
        for i, deviation, whitened in want:
            r = by[i, k + 1]
            assert r.deviation == deviation and abs(r.whitened - sign * whitened[k]) < 1e-9 and abs(r.explained / shares[k] - 1) < 1e-9


def test_odd_vectors(spark):
    rows = [(1, [0.5, 1.0, -2.0]), (2, [0.5, 1.0, -2.0]), (None, [1.5, 0.25]), (3, [1.5, 0.25, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan")]), (7, [float("inf"), 0.0]), (8, []), (9, [-1.0, 3.0, 0.1]), (9, [7.0, -2.0, 0.3])]
    df = spark.createDataFrame([(*r, "w", 3) for r in rows], "vec_id long, embedding array<double>, whitened string, n int")
    model, fit = fit_whitening(df)
    got = sorted(((r.vec_id is None, r.vec_id, r.deviation, r.whitened) for r in whiten(df, model).collect()), key=str)
    want, shares, n = brute(rows)
    assert model.n == n == 5 and len(got) == len(want) == 7 and np.allclose(model.explained, shares[:3])
    assert sorted(g[2] for g in got) == sorted(w[1] for w in want) and all(len(g[3]) == 3 for g in got)
    assert identity_error(fit, model) < 1e-10


def test_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    model, fit = fit_whitening(df)
    assert [r.whitened for r in whiten(df, model).collect()] == [[None, None]] * 2 and model.n == 1 and identity_error(fit, model) == 0
    assert model.explained.tolist() == [0, 0]
    line = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.col("id") * 2.0).alias("embedding"))
    model, fit = fit_whitening(line)
    rows = whiten(line, model).collect()
    assert model.explained[0] == pytest.approx(1) and all(r.whitened[1] is None and r.whitened[0] is not None for r in rows) and identity_error(fit, model) < 1e-10


def test_large_numbers(spark):
    """Products past 64 bits are exact before they are cut."""
    df = spark.createDataFrame([(1, [1e15, 3.0]), (2, [-1e15, 4.0]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    model, _ = fit_whitening(df)
    assert {r.deviation for r in whiten(df, model).collect()} == {2**63 - 1} and model.sums[0] == 2**63 - 1
