"""Stores and graphs that are kept and brought up to date, against plain Python or a full build."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillon.functions.hashing import embed_text, hash_embedding
from quillon.operators import graph, graph_refresh
from quillon.operators.embedding_store import EmbeddingStore


@F.pandas_udf(ArrayType(DoubleType()))
def picky(texts):
    """No vector for texts with x, a short one for those with y, one that is not finite for those with z."""
    def one(t):
        v = embed_text(t, 8)
        return None if "x" in t else v[:3] if "y" in t else [float("nan"), *v[1:]] if "z" in t else v

    return texts.map(one)


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_only_new_texts_are_embedded(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    first = rows(spark, ["a b", "c d", "a b", None, ""])
    assert store.ensure(first) == (3, 0)
    assert store.ensure(first) == (0, 0)
    changed = rows(spark, ["a b", "c d!", "a b", None, ""])
    assert store.ensure(changed) == (1, 0)
    found = {r.id: r.v for r in store.joined(changed).collect()}
    assert found[3] is None and all(np.allclose(found[i], embed_text(t)) for i, t in ((0, "a b"), (1, "c d!"), (2, "a b"), (4, "")))
    assert store.vectors().count() == 4 and [r.embedded for r in store.runs().orderBy("at").collect()] == [3, 0, 1]


def test_providers_in_turn_and_quarantine(spark, tmp_path):
    half = lambda text: F.when(F.contains(text, F.lit("q")), F.lit(None)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: i.cast("double")))
    texts = rows(spark, ["plain", "x", "y", "z", "xq", "yq"])
    store = EmbeddingStore(spark, str(tmp_path / "store"), 8, "two", [("picky", picky), ("half", half)])
    assert store.ensure(texts) == (4, 2)
    assert sorted(r.provider for r in store.vectors().collect()) == ["half", "half", "half", "picky"]
    assert {r.text: r.fault for r in store.quarantine().collect()} == {"xq": "no vector", "yq": "no vector"}
    assert store.ensure(texts) == (0, 0)
    alone = EmbeddingStore(spark, str(tmp_path / "alone"), 8, "one", [("picky", picky)])
    assert alone.ensure(texts) == (1, 5)
    faults = {r.text: r.fault for r in alone.quarantine().collect()}
    assert faults["y"] == "3 entries" and faults["z"] == "an entry is not finite"


def test_models_do_not_share_vectors(spark, tmp_path):
    texts = rows(spark, ["a"])
    assert EmbeddingStore(spark, str(tmp_path / "s"), model="one").ensure(texts) == (1, 0)
    assert EmbeddingStore(spark, str(tmp_path / "s"), model="two").ensure(texts) == (1, 0)


def test_a_run_that_dies_counts_for_nothing(spark, tmp_path):
    broken = lambda text: F.when(text == "b", F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(hash_embedding(text))
    texts = rows(spark, ["a", "b"])
    with pytest.raises(Exception, match="lost"):
        EmbeddingStore(spark, str(tmp_path / "s"), providers=[("broken", broken)]).ensure(texts)
    good = EmbeddingStore(spark, str(tmp_path / "s"))
    assert good.vectors().count() == 0 and good.ensure(texts) == (2, 0)


# --- graphs ---


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, v array<double>")


def edges_of(df):
    return sorted((r.src, r.dst, r.weight) for r in df.collect())


def test_deltas_equal_a_graph_built_anew(spark):
    rng = np.random.default_rng(4)
    state = {i: rng.standard_normal(6) for i in range(80)}
    kept, now = graph_refresh.full(frame(spark, state), 5), frame(spark, state)
    for step in range(3):
        gone = sorted(rng.choice(list(state), 7, replace=False).tolist())
        fresh = {int(i): rng.standard_normal(6) for i in [*rng.choice([i for i in state if i not in gone], 5, replace=False), 200 + step, 300 + step]}
        state = {i: v for i, v in state.items() if i not in gone} | fresh
        kept, now = graph_refresh.refreshed(kept, now, frame(spark, fresh), spark.createDataFrame([(i,) for i in gone], "id long"), 5)
        assert edges_of(kept) == edges_of(graph_refresh.full(frame(spark, state), 5))
        assert now.count() == len(state)


@pytest.mark.parametrize("depth", [1, 3, 50])
def test_reached_is_breadth_first(spark, depth):
    rng = random.Random(depth)
    links = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(45)})
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, weight double")
    starts = [0, 5, 29, 99]
    want = set()
    for s in starts:
        seen, frontier = {s: (0, None)}, [s]
        for d in range(1, depth + 1):
            step = {}
            for a, b in links:
                if a in frontier and b not in seen:
                    step[b] = min(step.get(b, a), a)
            seen |= {b: (d, a) for b, a in step.items()}
            frontier = list(step)
        want |= {(s, n, d, p) for n, (d, p) in seen.items()}
    found = graph.reached(edges, spark.createDataFrame([(s,) for s in starts], "id long"), depth)
    assert {tuple(r) for r in found.select("start", "node", "depth", "parent").collect()} == want and found.count() == len(want)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_tags_shared(spark, least):
    rng = random.Random(least)
    nodes = [(i, rng.sample("abcdefgh", rng.randint(0, 5)) + ["a"] * (i % 2)) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(nodes, "id long, tags array<string>")
    want = {(i, j, len(set(a) & set(b))) for i, a in nodes for j, b in nodes if i < j and a and b and len(set(a) & set(b)) >= least}
    assert {tuple(r) for r in graph.shared_tag_edges(df, least).collect()} == want


def test_a_tag_of_fifty_thousand_nodes(spark):
    """All nodes share one tag; two hundred pairs share another one."""
    nodes = spark.range(50_000).select("id", F.array(F.lit("hot"), F.concat(F.lit("t"), F.when(F.col("id") < 400, F.floor(F.col("id") / 2)).otherwise(F.col("id")).cast("string"))).alias("tags"))
    found = graph.shared_tag_edges(nodes, 2)
    assert found.count() == 200 and found.filter("dst <> src + 1").count() == 0


def test_boosted_keeps_edges_without_nodes(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 9, 0.4), (2, 3, 0.2)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(1, "c", ["x", "y"]), (2, "c", ["y", "z"]), (3, None, None)], "id long, category string, tags array<string>")
    assert {(r.src, r.dst): round(r.weight, 9) for r in graph.boosted(edges, nodes).collect()} == {(1, 2): 0.75, (1, 9): 0.4, (2, 3): 0.2}


def test_pairs_of_a_group_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "MEMBERS", 7)
    rng = random.Random(3)
    nodes = spark.createDataFrame([(i, rng.choice([1, 2, None])) for i in range(60)], "id long, group int")
    edges = spark.createDataFrame([(a, b, 0.5 + a / 100) for a, b in {(rng.randrange(65), rng.randrange(65)) for _ in range(150)}], "src long, dst long, weight double")
    want = {(r.src, r.dst): round(r.weight, 9) for r in graph.combined(edges, graph.shared_group_edges(nodes, 0.15)).collect()}
    for most in (10**6, 0):
        monkeypatch.setattr(graph, "MAX_MEMBERS", most)
        found = graph.with_group_edges(edges, nodes, 0.15)
        got = found.collect()
        assert len(got) == len(want) and {(r.src, r.dst): round(r.weight, 9) for r in got} == want
        assert "keys=[src" not in found._jdf.queryExecution().executedPlan().toString().split("Union")[0]


def test_tagged_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "MEMBERS", 3)
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([["a", "b"], ["b", "c", "a"], ["c", "d"], ["a"], ["a", "a", "b"], [None, "c", "a", "b"], None])) for i in range(40)]
    nodes = spark.createDataFrame(rows, "id long, category string, tags array<string>")
    links = {(a, b): 0.5 + a / 100 for a, b in {(rng.randrange(43), rng.randrange(43)) for _ in range(80)}}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src long, dst long, weight double")
    at = {i: (c, set(t or []) - {None}) for i, c, t in rows}
    want = {p: round(r, 9) for p, r in ((tuple(x[:2]), x[2]) for x in graph.boosted(edges, nodes).collect())}
    for a, (ca, ta) in at.items():
        for b, (cb, tb) in at.items():
            if a != b and (a, b) not in links and len(ta & tb) >= 2:
                want[a, b] = round(0.15 * (ca is not None and ca == cb) + 0.1 * len(ta & tb), 9)
    for most in (10**6, 0):
        monkeypatch.setattr(graph, "MAX_MEMBERS", most)
        got = graph.tagged(edges, nodes, 2).collect()
        assert len(got) == len(want) and {(r.src, r.dst): round(r.weight, 9) for r in got} == want


# --- texts under a budget ---


def test_texts_are_cut_to_whole_sentences(spark):
    from quillon.functions import text as T
    from quillon.operators import fusion

    long = ". ".join(f"Sentence number {i} tells of the design and structure of thing {i}" for i in range(60)) + "."
    rows = [(1, i, f"c{i % 3}", 1.0 - i / 20, long if i % 2 else "Short text. It fits.") for i in range(8)] + [(2, 9, "c", 0.5, long), (2, 10, "c", 0.4, "Two. Three.")]
    results = spark.createDataFrame(rows, "query_id long, id long, category string, score double, text string")
    taken = {(r.query_id, r.id): (r.place, r.used) for r in fusion.compressed(results, 1200).collect()}
    found = {(r.query_id, r.id): r for r in fusion.compressed_texts(results, 1200).collect()}
    assert found.keys() == taken.keys()
    texts = {(r[0], r[1]): r[4] for r in rows}
    sentences = {s.strip() for s in long.split(".")}
    cut = 0
    for key, r in found.items():
        assert (r.place, r.used) == taken[key] and len(r.text) <= max(4 * r.used, len(texts[key]) if 4 * r.used >= len(texts[key]) else 0)
        if r.text != texts[key]:
            cut += 1
            assert set(r.text.split(". ")) <= sentences
            one = spark.createDataFrame([(texts[key],)], "t string").select(T.key_points(F.col("t"), F.lit(4 * r.used))).first()[0]
            assert r.text == one
    assert cut and found[2, 9].text == long  # three results at most pass as they are
