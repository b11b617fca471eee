"""Percentiles by ranges against sorted lists; sketches within the error that is stated."""

import math

import numpy as np
import pytest

from quillon.operators import quantiles as qt

SHARES = {"least": 0.0, "p50": 0.5, "p99": 0.99, "most": 1.0}


def test_exact_against_sorted_lists(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.lognormal(size=3000)] + [("ties", float(x)) for x in rng.integers(0, 3, 500)] + [("one", 4.0), (None, 1.0), (None, 2.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(5)
    found = {r.key: (r.n, [r[s] for s in SHARES]) for r in qt.exact_percentiles(df, ["key"], "value", SHARES).collect()}
    want = {}
    for key in {k for k, v in rows if v is not None}:
        xs = sorted(v for k, v in rows if k == key and v is not None)
        want[key] = (len(xs), [xs[min(math.floor(len(xs) * p), len(xs) - 1)] for p in SHARES.values()])
    assert found == want


def test_exact_of_no_rows(spark):
    assert qt.exact_percentiles(spark.createDataFrame([], "key string, value double"), ["key"], "value", SHARES).count() == 0


def test_sketches_merge_within_their_error(spark):
    n = 40_000
    df = spark.range(n).selectExpr("id % 7 as day", "'a' as key", "pow(pmod(id * 7919, 40000) / 40000D, 3) as value", "id % 9000 as user")
    daily = qt.sketched(df, ["key", "day"], "value", "user")
    row = qt.estimated(qt.merged(daily, ["key"]), {"p50": 0.5, "p95": 0.95}).first()
    assert row.n == n
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        assert row[name] ** (1 / 3) == pytest.approx(p, abs=0.02)  # the value's own rank
    assert row.distinct == pytest.approx(9000, rel=0.05)


def test_sketch_of_a_key_without_values(spark):
    df = spark.createDataFrame([("a", None, None)], "key string, value double, user long")
    row = qt.estimated(qt.sketched(df, ["key"], "value", "user"), {"p50": 0.5}).first()
    assert (row.n, row.p50, row.distinct) == (0, None, 0)
