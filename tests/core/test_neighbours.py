"""All neighbours of a table: the screen in single precision loses none, and results that read the edges several times make them once."""

import numpy as np
import pytest

from quillon.operators import dense, graph, graph_refresh, vector_index
from quillon.plans import register, registry  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def wanted(x, ids, q, q_id, k, least, self_pairs):
    scores = vector_index.similarities("cosine", x, q)
    if not self_pairs:
        scores[q_id[:, None] == ids[None, :]] = -np.inf
    scores[scores < least] = -np.inf
    return [[(ids[c], s[c]) for c in np.lexsort((ids, -s))[:k] if s[c] > -np.inf] for s in scores]


def odd(kind, rng):
    x = rng.standard_normal((2500, 16))
    if kind == "copies":
        x[:2000] = x[rng.integers(0, 40, 2000)]
    elif kind == "close":  # differences that single precision doesn't tell
        x = x[:1] + 1e-4 * x
    elif kind == "sizes":
        x *= 10.0 ** rng.integers(-90, 90, 2500)[:, None]
        x[::50] = 0
    elif kind == "rising":  # every block is nearer than the one before
        x = x[:1] * np.linspace(0, 5, 2500)[:, None] + x
    return x


@pytest.mark.parametrize("kind", ["plain", "copies", "close", "sizes", "rising"])
@pytest.mark.parametrize(("least", "self_pairs"), [(0.1, False), (-2, True), (0.7, False)])
def test_screen_loses_no_neighbour(monkeypatch, kind, least, self_pairs):
    monkeypatch.setattr(vector_index, "BLOCK", 512)
    rng = np.random.default_rng(5)
    x, ids = odd(kind, rng), rng.permutation(2500)
    ids[7] = ids[8]
    q, q_id = np.concatenate([x[:90], -x[90:100]]), ids[:100]
    row, column, score, left = vector_index.Screen(x, ids).best(q, q_id, 7, least, self_pairs)
    want = wanted(x, ids, q, q_id, 7, least, self_pairs)
    for i in set(range(100)) - set(left):
        got = [(ids[c], s) for r, c, s in zip(row, column, score, strict=True) if r == i]
        assert [g[0] for g in got] == [w[0] for w in want[i]] and np.allclose([g[1] for g in got], [w[1] for w in want[i]], atol=1.5e-9)
    assert not set(row) & set(left) and (kind in ("copies", "close") or len(left) <= 2)


def test_odd_vectors_are_left_over():
    x = np.ones((3000, 4))
    q = np.array([[1.0, 0, 0, 0], [np.nan, 0, 0, 0], [1e200, 0, 0, 0]])
    assert list(vector_index.Screen(x * np.arange(1, 3001)[:, None], np.arange(3000)).best(q, np.arange(3), 3, None, True)[3]) == [0, 1, 2]
    x[5] = np.inf
    assert len(vector_index.Screen(x, np.arange(3000)).best(q, np.arange(3), 3, None, True)[3]) == 3


def test_parts_meet_in_a_grid(spark, monkeypatch):
    for name, value in (("ROWS", 1500), ("BLOCK", 512), ("CELLS", 10**6)):
        monkeypatch.setattr(vector_index, name, value)
    x = np.random.default_rng(6).standard_normal((4000, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = dense.knn(frame, frame.withColumnRenamed("id", "query_id"), 5, least=0.1)
    got = sorted((r.query_id, r["rank"], r.id) for r in found.collect())
    ids = np.arange(4000)
    assert got == [(i, p + 1, int(j)) for i, near in enumerate(wanted(x, ids, x, ids, 5, 0.1, False)) for p, (j, _) in enumerate(near)]


@pytest.mark.parametrize("name", ["graph_augmented", "two_hop_neighbors", "graph_walk_scores"])
def test_edges_are_made_once(spark, name):
    assert "MapInArrow" not in register.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_deeper_lists_are_not_made_anew(spark, monkeypatch):
    """Deltas of a tenth: the lists equal new ones in their first entries, and hardly more than the fresh nodes are searched for."""
    rng, asked = np.random.default_rng(7), []
    frame = lambda x: spark.createDataFrame([(int(i), v.tolist()) for i, v in x.items()], "id long, v array<double>")
    state = {i: rng.standard_normal(6) for i in range(300)}
    kept, now = graph_refresh.lists(frame(state), 10, -2), frame(state)
    real = graph_refresh.knn
    monkeypatch.setattr(graph_refresh, "knn", lambda v, q, *a, **b: asked.append((v.count(), q.count())) or real(v, q, *a, **b))
    for step in range(3):
        gone = sorted(rng.choice(list(state), 30, replace=False).tolist())
        fresh = {} if step == 1 else {int(i): rng.standard_normal(6) for i in [*rng.choice([i for i in state if i not in gone], 10, replace=False), 500 + step]}
        state = {i: v for i, v in state.items() if i not in gone} | fresh
        asked.clear()
        kept, now = graph_refresh.renewed(kept, now, frame(fresh), spark.createDataFrame([(i,) for i in gone], "id long"), 5, 10, -2)
        assert step > 0 or sum(q for v, q in asked if v > len(fresh)) < 30
        got = sorted(map(tuple, graph_refresh.best(kept, 5).collect()))
        assert got == sorted(map(tuple, real_graph(real, frame(state), 5).collect()))


def real_graph(knn, v, k):
    return knn(v, v.withColumnRenamed("id", "query_id"), k, least=-2).selectExpr("query_id src", "id dst", "score weight")


def test_pairs_are_dealt_to_many_tasks(spark):
    """Nodes are little data and make many pairs: their deal isn't left to the data's size, and an edge's pair comes once."""
    nodes = spark.createDataFrame([(i, i % 2, "ab"[i % 2], ["x", "y", "z"[: i % 2]]) for i in range(40)], "id long, group int, category string, tags array<string>")
    edges = spark.createDataFrame([(0, 2, 0.5), (2, 0, 0.25), (0, 1, 0.125)], "src long, dst long, weight double")
    grouped, tagged = graph.with_group_edges(edges, nodes.select("id", "group"), 0.5), graph.tagged(edges, nodes.drop("group"), 2)
    for found in (grouped, tagged):
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.src, r.dst, r.weight) for r in grouped.collect()]
    assert len(got) == len(set(got)) == 2 * 190 + 2 and {(0, 2, 1.0), (2, 0, 0.25), (0, 1, 0.125)} <= set(got)
    assert tagged.count() == tagged.select("src", "dst").distinct().count() == 40 * 39
