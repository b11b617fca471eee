"""Queries of query analysis, fusion and diversity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import analysis, dense, fusion
from quillon.plans import common_sql as sql
from quillon.plans.dense import vectors
from quillon.plans.lexical import batch, index
from quillon.plans.register import query, table

FIXED = [
    (1001, "factory pattern"), (1002, "create objects"), (1003, "I need to create objects without specifying exact classes"),
    (1004, "How to implement a singleton pattern"), (1005, "what is the best way to learn how to structure a large system"),
    (1006, "use `map` here"), (1007, "singleton factory observer strategy"), (1008, ""), (1009, "abcdefg hijkl mnop qrst"),
]
ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in FIXED) + ") t(query_id, text) UNION ALL SELECT item_id, text FROM benchmark)"


def asked(spark, sf_dir):
    """Fixed queries and the benchmark's texts."""
    fixed = spark.createDataFrame(FIXED, "query_id long, text string")
    return fixed.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def _any(word: str, values) -> str:
    return "(" + " OR ".join(f"contains({word}, '{v}')" for v in values) + ")"


def _score(values, each: float) -> str:
    return f"least(({' + '.join(f'contains(low, {v!r})::INT' for v in values)}) * {each}::DOUBLE, 0.5)"


ALPHA = f"""{ASKED},
a AS (SELECT *, lower(text) AS low, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 0) AS w FROM asked),
b AS (SELECT query_id, text, len(w) AS n, length(text) AS l, len(list_filter(w, lambda v: {_any('v', T.TECHNICAL)})) AS tech,
  {_score(T.EXPLORATORY, 0.15)} AS expl, {_score(T.SPECIFIC, 0.12)} AS spec, regexp_matches(text, '`[^`]+`|\\{{[^{{]+\\}}|\\([^(]+\\)') AS code,
  CASE WHEN length(text) = 0 THEN 0 ELSE len(list_distinct(string_split(text, '')))::DOUBLE / length(text) END AS entropy FROM a),
c AS (SELECT *, CASE WHEN n <= 2 AND spec >= 0.1 THEN 1 WHEN n > 5 AND expl > 0.2 THEN 2 WHEN tech > 0 AND n > 3 THEN 3 WHEN code THEN 4 WHEN entropy > 0.6 AND n > 3 THEN 5 ELSE 6 END AS br FROM b),
d AS (SELECT *, ([0.3, 0.7, 0.6, 0.4, 0.65, 0.5]::DOUBLE[])[br] + CASE WHEN l > 100 THEN 0.1 WHEN l < 30 THEN -0.15 ELSE 0 END::DOUBLE AS s,
  ([0.7, 0.3, 0.4, 0.6, 0.35, 0.5]::DOUBLE[])[br] - CASE WHEN l > 100 THEN 0.1 WHEN l < 30 THEN -0.15 ELSE 0 END::DOUBLE AS k FROM c),
alpha AS (SELECT query_id, text, greatest(0.1::DOUBLE, least(0.9::DOUBLE, s / (s + k))) AS semantic_alpha, greatest(0.1::DOUBLE, least(0.9::DOUBLE, k / (s + k))) AS keyword_alpha,
  ['specific', 'exploratory', 'exploratory', 'specific', 'exploratory', 'balanced'][br] AS query_type,
  least(0.9::DOUBLE, ([0.7, 0.75, 0.65, 0.6, 0.55, 0.5]::DOUBLE[])[br] + tech * 0.05::DOUBLE) AS confidence FROM d)"""


@query(f"WITH {ALPHA} SELECT query_id, round(semantic_alpha, 9) AS semantic_alpha, round(keyword_alpha, 9) AS keyword_alpha, query_type, round(confidence, 9) AS confidence FROM alpha")
def dat_alpha(spark, sf_dir):
    r = lambda c: F.round(c, 9).alias(c)
    return analysis.dynamic_alpha(asked(spark, sf_dir)).select("query_id", r("semantic_alpha"), r("keyword_alpha"), "query_type", r("confidence"))


@query(f"""WITH {ASKED},
a AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 0) AS w FROM asked),
b AS (SELECT query_id, len(w) AS n, len(list_filter(w, lambda v: {_any('lower(v)', T.ENGINE_TERMS)})) AS t,
  CASE WHEN text = '' THEN 0 ELSE len(list_distinct(string_split(lower(text), '')))::DOUBLE / length(text) END AS e, regexp_matches(text, '`[^`]+`|\\{{[^{{]+\\}}') AS c FROM a),
d AS (SELECT *, CASE WHEN n <= 3 AND t > 0 THEN 1 WHEN n > 5 AND e < 0.6 THEN 2 WHEN c THEN 3 WHEN e > 0.65 AND n > 3 THEN 4 ELSE 5 END AS br FROM b)
SELECT query_id, ['specific', 'exploratory', 'specific', 'exploratory', 'balanced'][br] AS query_type,
  CASE WHEN t > 2 AND br NOT IN (2, 4) THEN 'hybrid' ELSE ['sparse', 'dense', 'hybrid', 'dense', 'hybrid'][br] END AS strategy,
  round(least(1, ([0.8, 0.75, 0.7, 0.6, 0.5]::DOUBLE[])[br] + CASE WHEN t > 2 THEN 0.1 ELSE 0 END), 9)::DOUBLE AS confidence FROM d""")
def query_analysis(spark, sf_dir):
    return analysis.strategy(asked(spark, sf_dir)).select("query_id", "query_type", "strategy", F.round("confidence", 9).alias("confidence"))


#: Documents have no vectors of their own: a query's dense leg is the nearest vectors of the vector with its number.
DENSE_SQL = """v AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
dense AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v) WHERE rank <= 10)"""
SPARSE_SQL = "sparse AS (SELECT query_id, id, norm AS score, rank FROM (SELECT query_id, id, round(norm, 9) AS norm, row_number() OVER (PARTITION BY query_id ORDER BY round(norm, 9) DESC, id) AS rank FROM m) WHERE rank <= 10)"


def dense_leg(spark, sf_dir, k: int = 10):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    v = vectors(spark, sf_dir)
    return dense.knn(v, v.join(ids, "id").withColumnRenamed("id", "query_id"), k)


def sparse_leg(spark, sf_dir, k: int = 10):
    return index(spark, sf_dir).best(batch(spark, sf_dir), k).withColumnRenamed("norm", "score")


BLEND_SQL = f"""WITH {sql.BM25}, {ALPHA}, {DENSE_SQL}, {SPARSE_SQL},
j AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id, coalesce(d.score, 0) AS semantic, least(coalesce(s.score, 0), 0.99::DOUBLE) AS keyword
  FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.id = s.id),
blended AS (SELECT j.*, greatest(0, least(1, CASE WHEN semantic > 0 AND keyword > 0 THEN (semantic_alpha * semantic + keyword_alpha * keyword) / (semantic_alpha + keyword_alpha)
  WHEN semantic > 0 THEN semantic ELSE keyword END))::DOUBLE AS confidence FROM j JOIN alpha USING (query_id))"""


def blended(spark, sf_dir):
    weights = analysis.dynamic_alpha(asked(spark, sf_dir))
    return fusion.blend(dense_leg(spark, sf_dir), sparse_leg(spark, sf_dir), weights)


@query(f"{BLEND_SQL} SELECT query_id, id, semantic, keyword, round(confidence, 9) AS confidence FROM blended")
def hybrid_blend(spark, sf_dir):
    return blended(spark, sf_dir).withColumn("confidence", F.round("confidence", 9))


RRF_SQL = f"""WITH {sql.BM25}, {DENSE_SQL}, {SPARSE_SQL},
u AS (SELECT query_id, id, 0.6::DOUBLE / (60 + rank) AS part FROM dense UNION ALL SELECT query_id, id, 0.4::DOUBLE / (60 + rank) FROM sparse
  UNION ALL SELECT query_id, id, 0.2::DOUBLE / 61 FROM dense WHERE rank <= 5),
rrf AS (SELECT query_id, id, least(sum(part) * CASE WHEN count(*) > 1 THEN 1.1::DOUBLE ELSE 1 END, 1) AS score, count(*)::BIGINT AS legs FROM u GROUP BY ALL)"""


def fused(spark, sf_dir):
    """The graph leg gives dense hits themselves, always at rank 1."""
    first = dense_leg(spark, sf_dir)
    graph = first.filter("rank <= 5").withColumn("rank", F.lit(1))
    return fusion.reciprocal_ranks({"dense": first, "sparse": sparse_leg(spark, sf_dir), "graph": graph})


@query(f"{RRF_SQL} SELECT query_id, id, round(score, 12) AS score, legs FROM rrf")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).withColumn("score", F.round("score", 12))


@query(f"""{RRF_SQL}, r AS (SELECT rrf.*, source, row_number() OVER (PARTITION BY query_id, lower(source) ORDER BY round(score, 12) DESC, id) = 1 OR round(score, 12) > 0.8 AS f FROM rrf JOIN documents d ON d.doc_id = id)
SELECT query_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, round(score, 12) DESC, id) AS place FROM r) WHERE place <= 6""")
def diverse_results(spark, sf_dir):
    found = fused(spark, sf_dir).withColumn("score", F.round("score", 12))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"))
    return fusion.diverse(found.join(docs, "id"), 6).select("query_id", "id", "place")


@query()
def mmr_diversify(spark, sf_dir):
    found = dense_leg(spark, sf_dir, 30).join(vectors(spark, sf_dir), "id")
    return fusion.mmr(found.select("query_id", "id", "score", "v"))


@query(f"""WITH {DENSE_SQL}, n AS (SELECT dense.query_id, p_name, p_brand, string_split(lower(p_type), ' ') AS tags, id, score FROM dense JOIN part ON p_partkey = id + 1),
w AS (SELECT *, ['brushed', 'small', 'brand', 'part'] AS w FROM n)
SELECT query_id, id, round(least(1, score * CASE WHEN contains(lower(p_name), 'brushed small brand part') THEN 1.2 ELSE 1 END::DOUBLE
  * pow(1.1::DOUBLE, len(list_filter(w, lambda x: contains(lower(p_brand), x))))
  * pow(1.05::DOUBLE, list_sum(list_transform(tags, lambda t: len(list_filter(w, lambda x: contains(t, x))))))), 9) AS score FROM w""")
def rerank_boosts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.split(F.lower("p_type"), " ").alias("tags"))
    found = dense_leg(spark, sf_dir).join(part, "id").withColumn("query", F.lit("brushed small brand part"))
    return fusion.reranked(found).select("query_id", "id", F.round("score", 9).alias("score"))


@query(f"""WITH {DENSE_SQL}, c AS (SELECT query_id, id, score, ceil(length(text) / 4)::BIGINT AS cost, source FROM dense JOIN documents d ON d.doc_id = id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(source) ORDER BY score DESC, id) = 1 OR score > 0.8 AS f FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, score DESC, id) AS place FROM f),
s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM p WHERE place <= 6)
SELECT query_id, id, place, greatest(least(cost, 1600 - spent), 0)::BIGINT AS used FROM s WHERE place = 1 OR spent < 1550""")
def context_compression(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), "text")
    return fusion.compressed(dense_leg(spark, sf_dir).join(docs, "id"), 2000)


@query()
def compressed_texts(spark, sf_dir):
    """The texts themselves, cut to their best sentences under what each result may use."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), "text")
    return fusion.compressed_texts(dense_leg(spark, sf_dir).join(docs, "id"), 2000)


@query(f"""WITH {sql.BM25}, {DENSE_SQL}, {SPARSE_SQL}, u AS (SELECT 1 AS prio, query_id, id, score FROM dense WHERE rank <= 5 UNION ALL SELECT 2, query_id, id, score FROM sparse WHERE rank <= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY prio) AS n FROM u)
SELECT query_id, id, prio, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prio, score DESC, id) AS place FROM k WHERE n = 1) WHERE place <= 8""")
def merged_search(spark, sf_dir):
    """Both legs one after the other, the first of each id kept, up to a limit."""
    legs = [leg(spark, sf_dir, 5).select(F.lit(p).alias("prio"), "query_id", "id", "score") for p, leg in ((1, dense_leg), (2, sparse_leg))]
    once = legs[0].unionByName(legs[1]).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("prio"))).filter("_n = 1")
    order = Window.partitionBy("query_id").orderBy("prio", F.desc("score"), "id")
    return once.withColumn("place", F.row_number().over(order)).filter("place <= 8").select("query_id", "id", "prio", "place")
