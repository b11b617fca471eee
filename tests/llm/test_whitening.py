"""Whitening against numpy's own eigenvectors and Python's whole numbers."""

import math

import numpy as np
import pytest

from quillon.llm import whitening as W

SMALL = "/root/testdata/sf0.001"


def brute(vectors, k=8):
    """n, exact deviations, whitened rows, shares of the covariance of all vectors."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(0)
    deviations = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, deviations, y @ vectors / np.sqrt(values), values / (sum(deviations) / n**3)


def check(rows, ids, vectors, k=8):
    n, deviations, expected, shares = brute(vectors, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * k
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        assert np.abs(mine * np.sign(mine @ expected[:, c]) - expected[:, c]).max() < 1e-7
    for i, exact in zip(ids, deviations, strict=True):
        r = got[i, 1]
        assert (r.n, int(r.deviation_exact)) == (n, exact) and r.deviation == (exact if exact < 2**63 else None)
    assert max(abs(got[ids[0], c + 1].explained / shares[c] - 1) for c in range(k)) < 1e-9
    assert rows[0].identity_error < 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<double>, n int")


def test_given_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(W.op13_block_lanczos_whitening(spark, SMALL).collect(), [r[0] for r in table], [r[1] for r in table])


def test_restarts_and_long_vectors(spark):
    """More dimensions than the basis holds: thick restarts reach the same components."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 90)) * np.linspace(3, 0.3, 90)
    rows = W.whitened(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]).repartition(3), 4, 4, 24).collect()
    check(rows, list(range(400)), x, 4)


def test_dropped_and_padded(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, -1.0, 2.0], [1.5, 0.25, 0.0], [0.0, 0.0, 7.0], [3.0, 1.0, 1.0], [-2.0, 0.125, 0.5], [1e-9, -1e-9, 4.0]]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(90, None, 1), (91, [1.0, None, 2.0], 1), (92, [nan, 1.0, 1.0], 1), (93, [1.0, -inf, 1.0], 1), (6, [2.5], 1), (7, [], 1)]
    found = W.whitened(frame(spark, rows)).collect()
    check(found, list(range(8)), [*good, [2.5, 0, 0], [0, 0, 0]], 3)


def test_exact_beyond_63_bits(spark):
    rows = [(i, [float(i * 10**8), 1.0]) for i in range(40)]
    found = W.whitened(frame(spark, [(*r, 0) for r in rows]), 1).collect()
    check(found, list(range(40)), [r[1] for r in rows], 1)
    assert any(r.deviation is None for r in found)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)], [(1, None, 0)], [(1, [], 0), (2, [], 0)]])
def test_no_variance_no_rows(spark, rows):
    assert W.whitened(frame(spark, rows)).collect() == []


def test_flat_directions_are_left_out(spark):
    rows = [(i, [float(i % 7), float(i % 3), 5.0, 5.0], 0) for i in range(21)]
    assert {r.component for r in W.whitened(frame(spark, rows)).collect()} == {1, 2}


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, [1.0, 0.5], 0), (None, [1.0, 0.5], 0), (3, [-1.0, 4.0], 0), (3, [2.0, 2.0], 0)]
    assert W.whitened(frame(spark, rows)).groupBy("vec_id").count().collect().__len__() == 2
    assert W.whitened(frame(spark, rows)).count() == 8


def test_breakdown_goes_on():
    """An operator whose Krylov space ends at once, with an eigenvalue of many dimensions."""
    basis = np.linalg.qr(np.random.default_rng(2).standard_normal((60, 60)))[0]
    values = np.array([9.0, 9.0, 9.0, 5.0, *[1.0] * 56])
    matrix = (basis * values) @ basis.T
    found, vectors, residuals = W.lanczos(lambda q: matrix @ q, 60, 6, 2, most=18)
    assert np.allclose(found, values[:6], atol=1e-11) and residuals.max() < 1e-10
    assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-12)


def test_passes_are_few(spark):
    df = W.usable(spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("vec_id", "embedding AS vector"))
    fit = W.fitted(df)
    assert fit.passes <= 8 and fit.residuals.max() < 1e-9 * fit.values[0]
