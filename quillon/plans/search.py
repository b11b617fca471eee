"""Whole searches for a batch of queries: the mediator's and the fused engine's, with their details."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import fusion as fu
from quillon.operators import fuzzy as fz
from quillon.operators import lexical as lx
from quillon.plans import common_sql as sql
from quillon.plans.dense import vectors
from quillon.plans.fusion import BLEND_SQL, DENSE_SQL, RRF_SQL, SPARSE_SQL, blended, dense_leg, fused, sparse_leg
from quillon.plans.register import query, table
from quillon.sources.shared import materialise

FLAGSHIP_SQL = f"""{BLEND_SQL},
details AS (SELECT doc_id AS id, source AS category, lang, substr(text, 1, 40) AS name FROM documents),
f AS (SELECT b.*, coalesce(category, 'unknown') AS category, coalesce(name, '') AS name, row_number() OVER (PARTITION BY query_id ORDER BY round(confidence, 9) DESC, b.id) AS rank FROM blended b LEFT JOIN details ON details.id = b.id WHERE confidence >= 0.05)
SELECT query_id, id, category, name, round(confidence, 9) AS confidence, rank FROM f WHERE rank <= 5"""


def mediated(spark, sf_dir, least: float = 0.05, k: int = 5):
    """Both legs, blended by the query's weights, with details of the documents; the k best of each query."""
    found = blended(spark, sf_dir).withColumn("confidence", F.round("confidence", 9)).filter(F.col("confidence") >= least)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.substring("text", 1, 40).alias("name"), "lang")
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(docs, "id", "left").na.fill({"category": "unknown", "name": ""})


@query(FLAGSHIP_SQL)
def search_flagship(spark, sf_dir):
    return mediated(spark, sf_dir).select("query_id", "id", "category", "name", "confidence", "rank")


@query()
def search_refined(spark, sf_dir):
    """The same rows with fuzzy relevance beside them; the confidence that ranks is not changed."""
    found = mediated(spark, sf_dir)
    s, k = fz.decomposed(F.col("semantic"), F.col("keyword"), F.col("confidence"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Very High")]), (F.col("id") % 4 + 1).cast("int"))
    scored = found.withColumns({"semantic": s, "keyword": k, "complexity": level, "fit": F.lit(0.5)})
    out = fz.defuzzified(fz.inferred(fz.membership(scored)))
    return out.select("query_id", "id", "rank", "confidence", F.round("relevance", 9).alias("relevance"), F.round("certainty", 9).alias("certainty"), "explanation")


@query(f"{RRF_SQL} SELECT query_id, id, round(score, 12) AS score, legs, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM rrf) WHERE rank <= 10")
def blended_rag(spark, sf_dir):
    found = fused(spark, sf_dir).withColumn("score", F.round("score", 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("query_id", "id", "score", "legs", "rank")


@query()
def blended_rag_diverse(spark, sf_dir):
    """The fused list, chosen for relevance and difference; documents without a vector are not candidates."""
    # a batch has few first hits: the vectors stay where they are read
    hits = materialise(blended_rag(spark, sf_dir).select("query_id", "id", "score"), "hits")
    found = vectors(spark, sf_dir).join(lx.sized_broadcast(hits), "id")
    return fu.mmr(found.select("query_id", "id", "score", "v"), keep=5)


@query("""WITH asked AS (SELECT unnest([3, 7, 100000, 100001]) AS id),
have AS (SELECT a.id, d.doc_id FROM asked a LEFT JOIN documents d ON d.doc_id = a.id),
near AS (SELECT id, vec_id, row_number() OVER (PARTITION BY id ORDER BY s DESC, vec_id) AS r FROM (
  SELECT h.id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s FROM have h JOIN embeddings q ON q.vec_id = h.id % 97 JOIN embeddings e ON e.vec_id <> q.vec_id WHERE h.doc_id IS NULL))
SELECT id::BIGINT AS id, 'found' AS kind, doc_id AS hit FROM have WHERE doc_id IS NOT NULL UNION ALL SELECT id, 'similar', vec_id FROM near WHERE r <= 3""")
def details_with_fallback(spark, sf_dir):
    """Documents by id; for ids that do not exist, the three nearest vectors."""
    from quillon.operators import dense

    ids = spark.createDataFrame([(3,), (7,), (100000,), (100001,)], "id long")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hit"))
    found = ids.join(docs, F.col("id") == F.col("hit")).select("id", F.lit("found").alias("kind"), "hit")
    lost = ids.join(docs, F.col("id") == F.col("hit"), "left_anti").withColumn("at", F.col("id") % 97)
    v = vectors(spark, sf_dir)
    near = dense.knn(v, v.join(lost, F.col("at") == v["id"]).select(F.col("at").alias("query_id"), "v"), 3)
    similar = lost.join(near.withColumnRenamed("id", "hit"), F.col("at") == F.col("query_id")).select("id", F.lit("similar").alias("kind"), "hit")
    return found.unionByName(similar)


@query(f"""WITH {sql.BM25}, l AS (SELECT lang, query_id, id, round(norm, 9) AS norm FROM m JOIN documents d ON d.doc_id = m.id)
SELECT query_id, lang, count(*)::BIGINT AS hits, max(norm) AS best FROM l GROUP BY ALL""")
def search_facets(spark, sf_dir):
    from quillon.plans.lexical import batch, index

    scores = index(spark, sf_dir).minmax(batch(spark, sf_dir)).select("query_id", "id", F.round("norm", 9).alias("norm"))
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return scores.join(lang, "id").groupBy("query_id", "lang").agg(F.count("*").alias("hits"), F.max("norm").alias("best"))


@query(f"WITH {sql.BM25}, {DENSE_SQL}, {SPARSE_SQL} SELECT query_id, count(*)::BIGINT AS shared FROM dense JOIN sparse USING (query_id, id) GROUP BY query_id")
def legs_compared(spark, sf_dir):
    """How many of each query's first ten hits the two legs share."""
    d, s = dense_leg(spark, sf_dir).select("query_id", "id"), sparse_leg(spark, sf_dir).select("query_id", "id")
    return d.join(s, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("shared"))


@query(f"{FLAGSHIP_SQL.replace('SELECT query_id, id, category, name, round(confidence, 9) AS confidence, rank FROM f WHERE rank <= 5', '')}, t AS (SELECT query_id, rank, rank || '. ' || name || ' (' || category || ')' AS line FROM f WHERE rank <= 5) SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS text FROM t GROUP BY query_id")
def search_text(spark, sf_dir):
    """Each query's results as numbered lines."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("name"), F.lit(" ("), F.col("category"), F.lit(")"))
    lines = mediated(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lines.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
