"""Values worked out by hand from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import hashing, text, vectors
from quillon.operators import analysis, code_rules, composition, compression, fusion, fuzzy, graph, lexical, telemetry

DOCS = [
    (1, "the factory method pattern defines an interface for creating an object"), (2, "abstract factory pattern creates families of related objects"),
    (3, "observer pattern notifies dependents of an event"), (4, "strategy pattern"), (5, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")


def brute_bm25(query):
    cut = lambda t: [w for w in t.split() if len(w) > 2]
    words = {i: cut(t) for i, t in DOCS}
    n, mean = len(DOCS), sum(map(len, words.values())) / len(DOCS)
    out = {}
    for i, w in words.items():
        s = 0.0
        for q in cut(query):
            df = sum(q in v for v in words.values())
            tf = w.count(q)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if s:
            out[i] = s
    return out


@pytest.mark.parametrize("query", ["factory pattern", "observer event", "factory factory", "zzz"])
def test_bm25(spark, docs, query):
    got = {r.id: r.score for r in lexical.bm25(docs, asked(spark, query)).collect()}
    want = brute_bm25(query)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_minmax(spark, docs):
    rows = lexical.minmax(lexical.bm25(docs, asked(spark, "factory pattern")), docs).collect()
    top = max(rows, key=lambda r: r.score)
    assert top.norm == 1.0 and all(0 <= r.norm <= 1 and abs(r.norm - r.score / top.score) < 1e-12 for r in rows)


ALPHA = {
    "factory pattern": (0.35, 0.65, "balanced", 0.60), "create objects": (0.15, 0.85, "specific", 0.70),
    "I need to create objects without specifying exact classes": (0.50, 0.50, "balanced", 0.50),
    "How to implement a singleton pattern": (0.60, 0.40, "exploratory", 0.75), "what is the best way to learn how to structure a large system": (0.70, 0.30, "exploratory", 0.80),
}


def test_dynamic_alpha(spark):
    for r in analysis.dynamic_alpha(asked(spark, *ALPHA)).collect():
        s, k, kind, c = ALPHA[r.text]
        assert (round(r.semantic_alpha, 6), round(r.keyword_alpha, 6), r.query_type, round(r.confidence, 6)) == (s, k, kind, c)


FUZZY = [
    ((0.9, 0.9, 0.8, "Medium"), (0, 0, 0, 1), 0.9, 0.95, 0.95), ((0.1, 0.1, 0.1, "Low"), (1, 0, 0, 0), 0.1, 0.15, 0.95), ((0.5, 0.3, 0.5, "High"), (0, 0, 0.75, 0), 0.7, 0.80, 0.775),
    ((0.4, 0.2, 0.5, "Medium"), (0, 0, 0.666667, 0), 0.7, 0.80, 0.70), ((0.55, 0.5, 0.7, "Very High"), (0, 0, 0.7, 0), 0.7, 0.80, 0.73),
]


def test_fuzzy(spark):
    rows = [(i, *case[0]) for i, case in enumerate(FUZZY)]
    frame = spark.createDataFrame(rows, "i int, semantic double, keyword double, fit double, complexity string")
    for r in fuzzy.defuzzified(fuzzy.inferred(fuzzy.membership(frame))).collect():
        _, sets, preliminary, crisp, certainty = FUZZY[r.i]
        assert all(abs(r[f"out_{s}"] - v) < 1e-6 for s, v in zip(fuzzy.SETS, sets, strict=True))
        assert abs(r.preliminary - preliminary) < 1e-6 and abs(r.relevance - crisp) < 1e-6 and abs(r.certainty - certainty) < 1e-6


def test_reciprocal_ranks(spark):
    leg = lambda *ids: spark.createDataFrame([(0, i, k + 1) for k, i in enumerate(ids)], "query_id long, id long, rank int")
    got = {r.id: r.score for r in fusion.reciprocal_ranks({"dense": leg(1, 2, 3, 4), "sparse": leg(4), "graph": leg(4, 9).filter("id = 4")}).collect()}
    assert abs(got[1] - 0.009836066) < 1e-8 and abs(got[2] - 0.009677419) < 1e-8 and abs(got[3] - 0.009523810) < 1e-8
    every = {r.id: r.score for r in fusion.reciprocal_ranks({"dense": leg(1), "sparse": leg(1), "graph": leg(1)}).collect()}
    assert abs(every[1] - 0.021639344) < 1e-8


def test_quantisation(spark):
    frame = spark.createDataFrame([([-1.0, -0.5, 0.0, 0.25, 1.0],), ([2.0, 2.0],)], "v array<double>").withColumn("q", vectors.quantised(F.col("v")))
    a, flat = frame.select("q", vectors.restored(F.col("q")).alias("r")).collect()
    assert a.q.codes == [-127, -64, 0, 32, 127] and abs(a.q.scale - 2 / 255) < 1e-12 and a.q.zero == 0
    assert [round(x, 6) for x in a.r] == [-0.996078, -0.501961, 0.0, 0.25098, 0.996078]
    assert flat.q.codes == [0, 0] and flat.q.scale == 0


def test_prefix_metrics(spark):
    ranked = spark.createDataFrame([(0, i, s, k + 1) for k, (i, s) in enumerate([(1, 0.9), (2, 0.8), (3, 0.7), (4, 0.2)])], "query_id long, id long, score double, rank int")
    truth = spark.createDataFrame([(0, 1), (0, 3)], "query_id long, id long")
    found = telemetry.prefix_metrics(ranked, truth)
    rows = {r["rank"]: r for r in found.collect()}
    assert [round(rows[k].precision, 6) for k in (1, 2, 3, 4)] == [1, 0.5, 0.666667, 0.5] and [rows[k].recall for k in (1, 2, 3, 4)] == [0.5, 0.5, 1, 1]
    assert abs(rows[4].ndcg - 0.816237) < 1e-6 and abs(telemetry.mean_average(found).first().map_reference - 0.479167) < 1e-6


def test_hashes(spark):
    frame = spark.createDataFrame([("factory",), ("design patterns",), ("",)], "t string")
    assert [r[0] for r in frame.select(hashing.rolling_hash(F.col("t"))).collect()] == [1091882742, 894679813, 0]
    assert frame.select(hashing.fnv1a(F.col("t"))).collect()[2][0] == 2166136261


def test_lists(spark):
    cases = {'["a","b"]': ["a", "b"], '"x\\ny"': ["x", "y"], "p\nq \n r": ["p", "q", "r"], "a, b,c": ["a", "b", "c"], "one;two": ["one", "two"], "single": ["single"], "": []}
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in frame.select("t", text.list_values(F.col("t")).alias("v")).collect()} == cases


def test_summary_and_expansion(spark):
    frame = spark.createDataFrame([("One two. The pattern design helps when structure is needed here now. Bye now.",)], "t string")
    assert frame.select(text.key_points(F.col("t"), 75)).first()[0] == "The pattern design helps when structure is needed here now. One two"
    one = spark.createDataFrame([("create design pattern",)], "t string").select(text.expanded(F.col("t"))).first()[0]
    assert one == ["create design pattern", "create instantiate build design pattern", "create software pattern"]


CODE = """class FooFactory { createFoo(x): Foo { return make(x); } }
abstract class BarFactory { factory(y) { if (a) { if (b) { if (c) { if (d) { if (e) { go(); } } } } } } }
const alpha = beta + gamma;
const delta = alpha + beta;
const omega = delta + beta;
const alpha = beta + gamma;
const delta = alpha + beta;
const omega = delta + beta;
"""


def test_code_rules(spark):
    code = spark.createDataFrame([(1, CODE)], "id long, code string")
    found = {(r.pattern, r.step): r.confidence for r in code_rules.design_patterns(code).collect()}
    assert found["Factory Method", 1] == 0.7 and found["Factory Method", 2] == 1.0
    assert [r.n for r in code_rules.duplicate_blocks(code).collect()] == [2]
    assert code.select(code_rules.nesting(F.col("code"))).first()[0] == 7
    assert {(r.pattern, r.severity) for r in code_rules.anti_patterns(code).collect()} == {("Spaghetti Code", "medium"), ("Copy-Paste Programming", "medium")}


def test_code_rules_say_where_and_why(spark):
    one = "a\n  static getInstance() { }\nbus.subscribe(x); notify(x)"
    other = "new A(); new B(); new C(); new D(); listener"
    code = spark.createDataFrame([(1, one), (2, other), (3, None), (4, "")], "id long, code string")
    found = {(r.pattern, r.step): (r.category, r.line, r.snippet) for r in code_rules.design_patterns(code).filter("id = 1").collect()}
    assert found["Singleton", 2] == ("Creational", 2, "static getInstance() { }")
    assert found["Observer", 1] == ("Behavioral", 3, "bus.subscribe(x); notify(x)")
    said = {(r.id, r.suggestion, r.confidence) for r in code_rules.suggestions(code).collect()}
    assert said == {(2, "Factory Method", 0.7), (2, "Observer", 0.6)}
    better = [(r.id, r.improvement) for r in code_rules.improvements(code).collect()]
    assert better.count((1, "thread safety")) == 1 and better.count((1, "unsubscribe")) == 2


def test_composition_anti_patterns(spark):
    rows = [(1, ["Singleton", "Prototype", "Observer"], ["for testing", "", "performance"]), (2, ["Adapter"] * 9, [None] * 9), (3, [], []), (4, None, None)]
    found = {(r.id, r.anti_pattern, r.severity, r.location) for r in composition.anti_patterns(spark.createDataFrame(rows, "id long, names array<string>, descriptions array<string>")).collect()}
    assert found == {
        (1, "Pattern Conflict", "medium", "Singleton + Prototype"), (1, "Singleton in Tests", "medium", "Singleton"), (1, "Observer Performance Issue", "low", "Observer"),
        (2, "Pattern Overload", "high", "Architecture"),
    }


def test_compression_there_and_back(spark):
    v = [0.5, -0.25, 0.125, 1.0] * 10
    rows = [(i, v, n) for i, n in enumerate(["quantize8", "quantize4", "pca", "distillation", "product_quantization", "adaptive", None, "odd"])] + [(8, [], "pca"), (9, None, "quantize8"), (10, [0.5] * 4, "quantize8")]
    got = {r.id: r for r in compression.decompressed(compression.compressed(spark.createDataFrame(rows, "id long, v array<double>, name string"))).collect()}
    assert [got[i].technique for i in range(10)] == ["quantize8", "quantize4", "pca", "distillation", "product_quantization", "quantize8", "quantize8", "none", "none", "none"]
    assert max(abs(a - b) for a, b in zip(got[0].restored, v)) < 0.005 and got[2].restored == v[:38] + [0.0, 0.0] and got[4].restored == v and got[3].restored is None
    assert got[0].ratio == 4.0 and got[0].speedup == 2.0 and len(got[3].codes) == 192 and got[1].drop > got[0].drop


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.1), (1, 5, 0.3), (5, 1, 0.3)], "src long, dst long, weight double")
    starts = spark.createDataFrame([(1,)], "id long")
    near = {(r.id, r.hops): round(r.score, 6) for r in graph.two_hops(edges, starts).collect()}
    assert near == {(2, 1): 0.9, (5, 1): 0.3, (3, 2): 0.85}
    paths = {tuple(r.path): round(r.score, 6) for r in graph.path_scores(graph.walk(edges, starts, 2)).collect()}
    assert paths == {(1, 2, 3): round(1.7 / 3 * math.exp(-0.4), 6)}
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60)], "a long, b long")
    assert {r.node: r.label for r in graph.connected(links).collect()} == {**{i: 0 for i in range(31)}, 50: 50, 60: 50}
