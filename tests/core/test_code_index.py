"""Search by product codes and by bytes, against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import code_index as ci


def table(spark, n=600, d=20, seed=3, clusters=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    x = centres[rng.integers(clusters, size=n)] + 0.3 * rng.normal(size=(n, d))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, rows[5][1]), (n + 1, rows[5][1]), (n + 2, [0.0] * d)]  # repeated vectors tie; zeros are near nothing
    return spark.createDataFrame(rows, "id long, v array<double>"), np.array([v for _, v in rows])


def truth(x, asked, k, least=-np.inf):
    norm = np.linalg.norm(x, axis=1)
    out = set()
    for q in asked:
        under = norm * norm[q]
        scores = np.round(np.divide(x @ x[q], under, out=np.zeros(len(x)), where=under > 0), 9)
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q and scores[i] >= least][:k]
        out |= {(q, int(i), place + 1) for place, i in enumerate(order)}
    return out


def found(frame):
    return {(r.query_id, r.id, r["rank"]) for r in frame.collect()}


def asked_of(df, *ids):
    return df.filter(F.col("id").isin(*ids)).withColumnRenamed("id", "query_id")


@pytest.mark.parametrize("kind", ["product", "bytes"])
def test_margin_of_one_loses_nothing(spark, tmp_path, kind):
    df, x = table(spark)
    index = ci.CodeIndex.ensure(df, str(tmp_path / "codes"), kind)
    some = [0, 5, 17, 300, 600, 602]
    assert found(index.search(df, asked_of(df, *some), 10, margin=1.0)) == truth(x, some, 10)
    assert found(index.search(df, asked_of(df, *some), 7, margin=1.0, least=0.6)) == truth(x, some, 7, 0.6)
    assert found(index.search(df, asked_of(df, 3), 10**3, margin=1.0)) == truth(x, [3], 10**3)  # more than there are
    own = index.search(df, asked_of(df, 17), 1, margin=1.0, self_pairs=True).first()
    assert (own.id, own.score) == (17, 1.0)


@pytest.mark.parametrize("kind", ["product", "bytes"])
def test_measured_margin_reaches_its_recall_with_few_candidates(spark, tmp_path, kind):
    df, x = table(spark, n=3000, clusters=100)
    index, some = ci.CodeIndex.ensure(df, str(tmp_path / "codes"), kind), list(range(0, 3000, 50))
    asked = asked_of(df, *some)
    want = {(q, i) for q, i, _ in truth(x, some, 10)}
    got = {(q, i) for q, i, _ in found(index.search(df, asked, 10))}
    assert len(want & got) >= 0.9 * len(want)
    assert 0 <= index.margin <= 1
    few, all_ = index.candidates(df, asked).count(), index.candidates(df, asked, margin=1.0).count()
    assert few <= all_ and few < 0.1 * len(some) * len(x)


def test_error_bounds_scores_and_restoring_is_as_stated(spark, tmp_path):
    df, x = table(spark)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    for kind, most in (("product", 0.6), ("bytes", 0.02)):
        index = ci.CodeIndex.ensure(df, str(tmp_path / kind), kind)
        rows = {r.id: r for r in index.restored().collect()}
        assert rows.keys() == set(range(len(x)))
        y, e = np.array([rows[i].v for i in range(len(x))]), np.array([rows[i].error for i in range(len(x))])
        assert np.allclose(np.linalg.norm(u - y, axis=1), e, atol=1e-12) and e[:-1].mean() < most
        form = ci.FORMS[kind](index.state, index.d)
        codes = form.codes(u)
        assert np.allclose(form.scores(u[:9], codes), u[:9] @ y.T, atol=1e-12)
        assert (np.abs(u[:9] @ u.T - u[:9] @ y.T) <= e[None, :] + 1e-12).all()


def test_odd_vectors_tables_and_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ci, "ROWS", 7)
    monkeypatch.setattr(ci, "STEP", 2)
    df, x = table(spark, n=50, d=5)
    odd = spark.createDataFrame([(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 0.0, 0.0, 0.0]), (904, [float("nan")] * 5), (905, [float("inf"), 0.0, 0.0, 0.0, 0.0])], "id long, v array<double>")
    both = df.unionByName(odd)
    index = ci.CodeIndex.ensure(both.withColumn("error", F.lit("x")), str(tmp_path / "odd"))
    assert (index.n, index.d) == (len(x), 5)
    some = [0, 1, 2, 3, 49]
    assert found(index.search(both, asked_of(both, *some, 900, 901, 902, 903, 904, 905), 4, margin=1.0)) == truth(x, some, 4)
    empty = ci.CodeIndex.ensure(df.limit(0), str(tmp_path / "none"))
    assert empty.search(df.limit(0), asked_of(df, 1)).collect() == [] and empty.restored().collect() == []
    one = ci.CodeIndex.ensure(df.limit(1), str(tmp_path / "one"), "bytes")
    assert one.search(df.limit(1), asked_of(df, 0)).collect() == []


def test_made_once(spark, tmp_path):
    df, x = table(spark, n=40)
    first = ci.CodeIndex.ensure(df, str(tmp_path / "codes"))
    lost = df.withColumn("v", F.raise_error(F.lit("read again")).cast("array<double>"))
    assert ci.CodeIndex.ensure(lost, str(tmp_path / "codes")).codes.count() == first.codes.count() == len(x)


def test_candidates_are_ranked_where_they_are_found(spark, tmp_path, monkeypatch):
    """With a margin of 1 nearly all pairs are candidates; they are never rows of a table."""
    df, x = table(spark)
    index = ci.CodeIndex.ensure(df, str(tmp_path / "codes"))
    monkeypatch.setattr(ci, "VECTORS", 100 * 20 * 8)  # parts of a hundred vectors
    monkeypatch.setattr(ci.CodeIndex, "candidates", lambda *_: pytest.fail("candidates as rows"))
    some = [0, 5, 17, 602]
    assert found(index.search(df, asked_of(df, *some), 10, margin=1.0)) == truth(x, some, 10)
