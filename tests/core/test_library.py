"""State machines, streams, ingestion, properties, and that the parts fit together."""

import json
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.functions import vectors
from quillon.operators import compression, dense, vector_index
from quillon.plans import register, registry  # noqa: F401
from quillon.sources import catalog_json as cj
from quillon.streaming import events as ev
from quillon.streaming import machines as mc

ROOT = Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"


def steps(machine, events):
    state, out = None, []
    for now, event in events:
        state = machine.start(now) if state is None else state
        state, verdict, _ = machine.step(state, now, event)
        out.append(verdict)
    return out


def test_token_bucket():
    bucket = mc.TokenBucket(burst=2, per_minute=60)
    assert steps(bucket, [(0, "x"), (1, "x"), (2, "x"), (59_999, "x"), (60_000, "x"), (60_001, "x")]) == ["allowed", "allowed", "limited", "limited", "allowed", "limited"]


def test_circuit_breaker():
    breaker = mc.CircuitBreaker(failures=2, successes=2, recovery=100)
    run = [(0, "error"), (1, "error"), (50, "ok"), (101, "ok"), (102, "ok"), (103, "error"), (104, "error"), (300, "error")]
    assert steps(breaker, run) == ["closed", "open", "rejected", "half_open", "closed", "closed", "open", "open"]


def test_cache():
    cache = mc.Cache(size=2, ttl=100)
    assert steps(cache, [(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b"), (200, "b")]) == ["miss", "miss", "hit", "miss", "miss", "miss"]


def test_stream_equals_batch(spark):
    e = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    pick = lambda df: df.select(F.col("user_id").cast("string").alias("key"), "ts", "event_id", F.col("event_type").alias("event"))
    machine = mc.CircuitBreaker(failures=2, recovery=3_600_000)
    batch = sorted(map(tuple, mc.replay(pick(e), machine).collect()))
    assert batch == sorted(map(tuple, ev.run_once(mc.stream(pick(ev.event_stream(spark, SMALL)), machine)).collect()))
    assert {r[2] for r in batch} >= {"closed", "open"}


def test_read_catalog(spark, tmp_path):
    one = {"id": "a-b", "name": "A", "category": "x", "description": "d", "complexity": "Low", "tags": ["t"], "benefits": "p\nq", "examples": {"go": {"language": "go", "code": "c"}}}
    two = {"patterns": [{"id": "B!", "name": "B", "category": "x", "description": "d", "complexity": "Odd", "relationships": [{"targetPatternId": "A", "type": "uses", "strength": 2}, {"target_pattern_id": "a-b"}]}, {"id": "c"}]}
    for name, value in (("one", json.dumps(one)), ("two", json.dumps(two)), ("bad", "{broken")):
        (tmp_path / f"{name}.json").write_text(value)
    rows = cj.read_catalog(spark, str(tmp_path))
    good, bad = cj.required(rows)
    assert {r.id for r in good.collect()} == {"a-b", "B!"} and bad.count() == 2
    report = {r.id: (r.valid, r.text) for r in cj.report(good).collect()}
    assert report["a-b"] == (True, "valid") and report["B!"][1].count("\n") == 3
    assert [(r.src, r.dst, r.strength) for r in cj.links(good).collect()] == [("B!", "a-b", 2.0)]
    listed = {r.id: r for r in cj.with_lists(good).collect()}
    assert listed["a-b"].benefits == ["p", "q"] and cj.examples(good).first().language == "go"
    assert cj.written(good.select("id", "tags")).filter("id = 'a-b'").first().tags == "t"


def test_knn_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(vector_index, "ROWS", 25)
    got = {(r.query_id, r["rank"]): r.id for r in dense.knn(frame, frame.withColumnRenamed("id", "query_id"), 3).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9)
    np.fill_diagonal(near, -2)
    want = {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.lexsort((np.arange(60), -near[i]))[:3])}
    assert got == want


def test_kmeans_and_projections(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(30, 4)) + 20 * k for k in range(3)])[rng.permutation(90)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    clusters = {r.id: r.cluster for r in dense.kmeans(frame, 3).collect()}
    assert len(set(clusters.values())) >= 2
    p = np.array([r.p for r in compression.pca(frame, 2).orderBy("id").collect()])
    assert abs(p.mean()) < 1e-9 and p[:, 0].var() > p[:, 1].var()
    codes = compression.product_quantised(frame, 2, 4).collect()
    assert all(len(r.codes) == 2 and max(r.codes) < 4 for r in codes)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=20))
def test_quantisation_error(spark, values):
    frame = spark.createDataFrame([(values,)], "v array<double>").withColumn("q", vectors.quantised(F.col("v")))
    q, back = frame.select("q", vectors.restored(F.col("q"))).first()
    if q.scale > 1e-6:
        assert all(abs(a - b) <= 1.01 * q.scale for a, b in zip(values, back, strict=True))


#: Some of every module; the driver compares all of them.
SAMPLE = "bm25_top10 tfidf_true_df knn_cosine quantize_int8_error dat_alpha rrf_fusion fuzzy_infer_defuzz two_hop_neighbors top3_per_parent integrity_report percentiles_floor precision_ndcg_at_k query_expansion composition_analysis validation_faults search_flagship streamed_hourly".split()


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    rows = register.QUERIES[name](spark, SMALL)
    columns = sorted(rows.columns)
    plain = lambda v: "-" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    db = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    cursor = db.execute(register.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_nothing_else_imports_the_corpus_part():
    for path in (ROOT / "quillon").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"quillon\.llm|corpus_pipeline", path.read_text()), path


def test_entry(spark):
    assert entry.queries().keys() >= entry.oracle_sql().keys() and len(register.QUERIES) > 120
    assert entry.entry(spark).count() > 0
