"""Queries of dense retrieval over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import dense as dn
from quillon.operators.code_index import CodeIndex
from quillon.operators.inverted_index import fingerprint
from quillon.operators.vector_index import VectorIndex
from quillon.sources.shared import shared_dir
from quillon.plans.register import query, table


def vectors(spark, sf_dir):
    """(id, v)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"))


PAIRS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {0} AS score, a.label AS la, b.label AS lb FROM e a JOIN e b ON a.vec_id <> b.vec_id {1}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""
COSINE = "round(list_cosine_similarity(a.v, b.v), 9)"


@query(f"WITH {PAIRS.format(COSINE, '')} SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def knn_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return dn.knn(v, v.withColumnRenamed("id", "query_id"), 10)


@query(f"WITH {PAIRS.format('round(1 / (1 + list_distance(a.v, b.v)), 9)', '')} SELECT query_id, id, score, rank FROM r WHERE rank <= 5")
def knn_l2_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return dn.knn(v, v.withColumnRenamed("id", "query_id"), 5, "l2")


@query(f"WITH {PAIRS.format(COSINE, '')} SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1 AND lb IN (1, 2, 3)) WHERE rank <= 10")
def vector_search_filtered(spark, sf_dir):
    """Categories are filtered before similarities are made, the threshold after."""
    chosen = table(spark, sf_dir, "embeddings").filter(F.col("label").isin(1, 2, 3)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return dn.knn(chosen, vectors(spark, sf_dir).withColumnRenamed("id", "query_id"), 10, least=0.1)


def kept_index(spark, sf_dir):
    """The kept index of the vectors; the first query that needs it builds it."""
    v = vectors(spark, sf_dir)
    return VectorIndex.ensure(v, f"{shared_dir(spark)}/vector-index-{fingerprint(v)}")


@query()
def ann_cosine(spark, sf_dir):
    """Neighbours from the index; the queries are the rows whose id is divisible by 100, against all rows."""
    asked = vectors(spark, sf_dir).filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    return kept_index(spark, sf_dir).search(asked, 10)


@query("SELECT count(*)::BIGINT AS queries, (count(*) * least(10, (SELECT count(*) - 1 FROM embeddings)))::BIGINT AS wanted, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(spark, sf_dir):
    """Whether the index finds nine tenths of the exact neighbours."""
    v = vectors(spark, sf_dir)
    asked = v.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    true = dn.knn(v, asked, 10).select("query_id", "id")
    found = kept_index(spark, sf_dir).search(asked, 10).select("query_id", "id", F.lit(1).alias("found"))
    counts = true.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), F.count("found").alias("found"))
    asked = asked.agg(F.count("*").alias("queries"))
    return asked.join(F.broadcast(counts)).select("queries", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("reached"))


def kept_codes(spark, sf_dir, kind):
    """The kept codes of the vectors; the first query that needs them makes them."""
    v = vectors(spark, sf_dir)
    return CodeIndex.ensure(v, f"{shared_dir(spark)}/code-index-{kind}-{fingerprint(v)}", kind)


def by_codes(spark, sf_dir, kind, margin=None):
    v = vectors(spark, sf_dir)
    return kept_codes(spark, sf_dir, kind).search(v, v.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), 10, margin)


HUNDREDTH = f"WITH {PAIRS.format(COSINE, 'AND a.vec_id % 100 = 0')} SELECT query_id, id, score, rank FROM r WHERE rank <= 10"


@query(HUNDREDTH)
def codes_cosine_exact(spark, sf_dir):
    """All true neighbours by way of product codes and their errors."""
    return by_codes(spark, sf_dir, "product", 1.0)


@query(HUNDREDTH)
def byte_codes_cosine(spark, sf_dir):
    """All true neighbours by way of a byte for each place."""
    return by_codes(spark, sf_dir, "bytes", 1.0)


@query()
def codes_cosine(spark, sf_dir):
    """Neighbours by product codes with the margin measured for them."""
    return by_codes(spark, sf_dir, "product")


@query("SELECT count(*)::BIGINT AS queries, (count(*) * least(10, (SELECT count(*) - 1 FROM embeddings)))::BIGINT AS wanted, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def codes_recall(spark, sf_dir):
    """Whether the search by codes with their own margin finds nine tenths of the exact neighbours."""
    v = vectors(spark, sf_dir)
    asked = v.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    true = dn.knn(v, asked, 10).select("query_id", "id")
    found = by_codes(spark, sf_dir, "product").select("query_id", "id", F.lit(1).alias("found"))
    counts = true.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), F.count("found").alias("found"))
    return asked.agg(F.count("*").alias("queries")).join(F.broadcast(counts)).select("queries", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("reached"))


@query("SELECT kind, count(*)::BIGINT AS n, (count(*) * 256)::BIGINT AS bytes_before, (count(*) * width)::BIGINT AS bytes_after, true AS as_stated FROM embeddings, (VALUES ('product', 8), ('bytes', 64)) f(kind, width) GROUP BY kind, width")
def codes_restored(spark, sf_dir):
    """Vectors restored from codes: as far from the true ones as the codes say."""
    v, out = vectors(spark, sf_dir), None
    for kind in ("product", "bytes"):
        index = kept_codes(spark, sf_dir, kind)
        met = index.restored().withColumnRenamed("v", "r").join(v, "id").join(index.codes.select("id", F.length("codes").alias("bytes")), "id")
        off = F.abs(V.distance(V.unit(F.col("v")), F.col("r")) - F.col("error"))
        one = met.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.size("v").cast("long") * 4).alias("bytes_before"), F.sum("bytes").alias("bytes_after"), F.every(off < 1e-9).alias("as_stated"))
        out = one if out is None else out.unionByName(one)
    return out.filter("n > 0")


@query(f"WITH {PAIRS.format(COSINE, 'AND a.vec_id = 7')} SELECT id, score, rank FROM r WHERE rank <= 5")
def similar_by_id(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return dn.knn(v, v.filter("id = 7").withColumnRenamed("id", "query_id"), 5).select("id", "score", "rank")


@query("""SELECT label, i AS pos, round(avg(x), 9) AS mean FROM (
  SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL""")
def vector_mean(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("v"))
    return dn.vector_mean(v, ["label"]).select("label", F.posexplode("mean").alias("pos", "mean")).select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 9).alias("mean"))


@query("SELECT count(*)::BIGINT AS n, avg(len(embedding))::DOUBLE AS dimensions, (sum(len(embedding)) * 8)::BIGINT AS bytes FROM embeddings")
def vector_stats(spark, sf_dir):
    n = F.size("embedding")
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.avg(n).alias("dimensions"), (F.sum(n) * 8).alias("bytes"))


@query("""WITH first AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 20),
q AS (SELECT embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id = 7),
s AS (SELECT vec_id AS id, round(list_cosine_similarity(v, w), 9) AS score FROM first, q)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def prefix_knn(spark, sf_dir):
    """The variant that limits candidates to the first 2k by order before it scores them."""
    v = vectors(spark, sf_dir)
    return dn.knn(v.orderBy("id").limit(20), v.filter("id = 7").withColumnRenamed("id", "query_id"), 10, self_pairs=True).select("id", "score", "rank")


@query()
def kmeans_lloyd(spark, sf_dir):
    return dn.kmeans(vectors(spark, sf_dir), 8)


@query()
def cluster_centroids(spark, sf_dir):
    v = vectors(spark, sf_dir)
    clusters = dn.kmeans(v, 8)
    return dn.vector_mean(v.join(clusters, "id"), ["cluster"]).select("cluster", F.posexplode("mean").alias("pos", "mean"))


@query("""SELECT count(*) FILTER (score >= 0.1)::BIGINT AS hits, round(max(score), 9) AS top, round(avg(score), 9) AS mean FROM (
  SELECT list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS score FROM embeddings WHERE vec_id <> 3)""")
def search_analytics(spark, sf_dir):
    v = vectors(spark, sf_dir)
    one = v.filter("id = 3").select(F.col("v").alias("w"))
    scored = v.filter("id <> 3").join(F.broadcast(one)).select(V.cosine(F.col("v"), F.col("w")).alias("score"))
    return scored.agg(F.count_if(F.col("score") >= 0.1).alias("hits"), F.round(F.max("score"), 9).alias("top"), F.round(F.avg("score"), 9).alias("mean"))
