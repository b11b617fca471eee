"""Queries of vector functions and of embedding compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import compression as cp
from quillon.plans.dense import vectors
from quillon.plans.register import query

E_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
SUM = "list_sum(list_transform(v, lambda x: {0}))"


@query(f"""WITH {E_SQL}, m AS (SELECT *, list_avg(v) AS mean, {SUM.format('abs(x)')} AS w FROM e)
SELECT id, round(mean, 9) AS mean, round(list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / len(v), 9) AS variance,
  len(list_filter(v, lambda x: abs(x) < 0.01))::DOUBLE / len(v) AS sparsity,
  round(list_sum(list_transform(v, lambda x: CASE WHEN x = 0 THEN 0 ELSE -(abs(x) / w) * log2(abs(x) / w) END)) / log2(len(v)), 9) AS entropy FROM m""")
def vector_profile(spark, sf_dir):
    v = F.col("v")
    return vectors(spark, sf_dir).select(
        "id", F.round(V.mean(v), 9).alias("mean"), F.round(V.variance(v), 9).alias("variance"), V.sparsity(v).alias("sparsity"), F.round(V.entropy(v), 9).alias("entropy")
    )


@query(f"WITH {E_SQL} SELECT id, round(sqrt({SUM.format('x * x')}), 9) AS norm, round(list_sum(list_transform(v, lambda x: x / sqrt({SUM.format('x * x').replace('lambda x: x * x', 'lambda y: y * y')}))), 9) AS unit_sum FROM e")
def vector_normalise(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.round(V.norm(F.col("v")), 9).alias("norm"), F.round(V.total(V.unit(F.col("v"))), 9).alias("unit_sum"))


def quantise_sql(bits: int) -> str:
    low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    return f"""WITH {E_SQL}, s AS (SELECT *, (list_max(v) - list_min(v)) / {float(high - low)}::DOUBLE AS scale FROM e),
z AS (SELECT *, floor({float(low)}::DOUBLE - list_min(v) / scale + 0.5) AS zero FROM s),
c AS (SELECT *, list_transform(v, lambda x: greatest({low}, least({high}, floor(x / scale + zero + 0.5)))) AS codes FROM z)
SELECT id, round(scale, 12) AS scale, zero::BIGINT AS zero, list_sum(codes)::BIGINT AS code_sum,
  round(list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - (codes[i] - zero) * scale))) / len(v), 9) AS error FROM c"""


def quantise(spark, sf_dir, bits):
    q = vectors(spark, sf_dir).withColumn("q", V.quantised(F.col("v"), bits))
    error = F.zip_with("v", V.restored(F.col("q")), lambda a, b: F.abs(a - b))
    return q.select(
        "id", F.round("q.scale", 12).alias("scale"), F.col("q.zero").alias("zero"),
        F.aggregate("q.codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.round(V.mean(error), 9).alias("error"),
    )


@query(quantise_sql(8))
def quantize_int8_error(spark, sf_dir):
    return quantise(spark, sf_dir, 8)


@query(quantise_sql(4))
def quantize_int4_error(spark, sf_dir):
    return quantise(spark, sf_dir, 4)


@query(quantise_sql(16))
def quantize_int16_error(spark, sf_dir):
    return quantise(spark, sf_dir, 16)


@query(f"WITH {E_SQL} SELECT id, 60 AS dims, 60 / 64::DOUBLE AS explained, round(list_sum(v[1:60]), 9) AS kept_sum FROM e")
def prefix_projection(spark, sf_dir):
    return cp.prefix_projection(vectors(spark, sf_dir)).select("id", "dims", "explained", F.round(V.total(F.col("p")), 9).alias("kept_sum"))


@query(f"""WITH {E_SQL}, m AS (SELECT *, list_avg(v) AS mean, {SUM.format('abs(x)')} AS w FROM e),
p AS (SELECT id, v, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / len(v) AS variance,
  len(list_filter(v, lambda x: abs(x) < 0.01))::DOUBLE / len(v) AS sparsity,
  list_sum(list_transform(v, lambda x: CASE WHEN x = 0 THEN 0 ELSE -(abs(x) / w) * log2(abs(x) / w) END)) / log2(len(v)) AS entropy FROM m)
SELECT id, CASE WHEN len(v) <= 128 THEN 'quantize8' WHEN sparsity > 0.7 THEN 'product_quantization' WHEN entropy < 0.3 THEN 'pca' WHEN variance > 0.1 THEN 'distillation' ELSE 'adaptive' END AS technique FROM p""")
def technique_selector(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", cp.technique(F.col("v")).alias("technique"))


@query()
def pca_projection(spark, sf_dir):
    out = cp.pca(vectors(spark, sf_dir), 8)
    return out.select("id", F.posexplode("p").alias("pos", "x"))


@query()
def pq_codes(spark, sf_dir):
    return cp.product_quantised(vectors(spark, sf_dir), 8, 16).select("id", F.posexplode("codes").alias("sub", "code"))


@query()
def random_projection(spark, sf_dir):
    return cp.random_projection(vectors(spark, sf_dir), 16, seed=11).select("id", F.posexplode("p").alias("pos", "x"))


@query("SELECT 'quantize8' AS technique, 256 AS bytes_before, 72 AS bytes_after, round(256 / 72::DOUBLE, 9) AS ratio, round(sqrt(256 / 72::DOUBLE), 9) AS speedup, count(*)::BIGINT AS n, (count(*) * (256 - 72))::BIGINT AS saved FROM embeddings")
def compression_savings(spark, sf_dir):
    return cp.savings(vectors(spark, sf_dir), 64, 8)


@query(f"""WITH {E_SQL}, s AS (SELECT *, list_sum(list_transform(v[1:62], lambda x: x * x)) / list_sum(list_transform(v, lambda x: x * x)) AS e FROM e)
SELECT id, CASE WHEN e >= 0.95 THEN 62 ELSE 64 END AS dims, round(CASE WHEN e >= 0.95 THEN e ELSE 1 END, 9)::DOUBLE AS explained FROM s""")
def energy_projection(spark, sf_dir):
    return cp.energy_projection(vectors(spark, sf_dir), 62).select("id", "dims", F.round("explained", 9).alias("explained"))


def _error(bits: int) -> str:
    low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    scale = f"((hi - lo) / {float(high - low)}::DOUBLE)"
    zero = f"floor({float(low)}::DOUBLE - lo / {scale} + 0.5)"
    return f"list_sum(list_transform(v, lambda x: abs(x - (greatest({low}, least({high}, floor(x / {scale} + {zero} + 0.5))) - {zero}) * {scale}))) / len(v)"


@query(f"""WITH {E_SQL}, m AS (SELECT *, list_min(v) AS lo, list_max(v) AS hi FROM e), t AS (SELECT id, {_error(4)} AS e4, {_error(8)} AS e8, {_error(16)} AS e16 FROM m)
SELECT id, CASE WHEN e4 <= 0.01 THEN 4 WHEN e8 <= 0.01 THEN 8 ELSE 16 END AS bits, round(CASE WHEN e4 <= 0.01 THEN e4 WHEN e8 <= 0.01 THEN e8 ELSE e16 END, 9) AS error FROM t""")
def quality_controlled(spark, sf_dir):
    return cp.quality_controlled(vectors(spark, sf_dir), 0.01).select("id", "bits", F.round("error", 9).alias("error"))


@query(f"""WITH {E_SQL}, s AS (SELECT *, (list_max(v) - list_min(v)) / 255.0::DOUBLE AS scale FROM e), z AS (SELECT *, floor(-128.0::DOUBLE - list_min(v) / scale + 0.5) AS zero FROM s),
d AS (SELECT id, v, list_transform(v, lambda x: (greatest(-128, least(127, floor(x / scale + zero + 0.5))) - zero) * scale) AS r FROM z)
SELECT id, round(list_sum(list_transform(range(1, 65), lambda i: (v[i] - r[i]) * (v[i] - r[i]))) / 64, 12) AS loss, list_sum(list_transform(range(1, 65), lambda i: (abs(v[i] - r[i]) <= 0.002)::INT)) = 64 AS same FROM d""")
def distillation_loss(spark, sf_dir):
    """Mean squared error of vectors restored from 8 bits, and whether every place is nearly the same."""
    r = vectors(spark, sf_dir).withColumn("r", V.restored(V.quantised(F.col("v"), 8)))
    loss = V.mean(F.zip_with("v", "r", lambda a, b: (a - b) * (a - b)))
    return r.select("id", F.round(loss, 12).alias("loss"), V.nearly_equal(F.col("v"), F.col("r"), 0.002).alias("same"))


NAMES = ["quantize8", "quantize4", "pca", "distillation", "product_quantization", "adaptive"]


@query(f"""WITH {E_SQL}, m AS (SELECT id, v, list_min(v) AS lo, list_max(v) AS hi, ({NAMES!r})[(id % 6)::INTEGER + 1] AS name FROM e), t AS (SELECT *, {_error(4)} AS e4, {_error(8)} AS e8, least(192, floor(len(v) * 0.95))::INTEGER AS dims FROM m),
c AS (SELECT *, CASE WHEN name <> 'adaptive' THEN name WHEN least(1, e8 * 10) <= 0.05 THEN 'quantize8' WHEN (1 - dims / len(v)::DOUBLE) * 0.5 <= 0.05 THEN 'pca' ELSE 'product_quantization' END AS technique FROM t),
x AS (SELECT *, CASE technique WHEN 'quantize8' THEN e8 WHEN 'quantize4' THEN e4 ELSE 0 END AS err, CASE technique WHEN 'pca' THEN dims / len(v)::DOUBLE ELSE 1 END AS kept,
  CASE WHEN technique LIKE 'quantize%' THEN len(v) WHEN technique = 'pca' THEN dims * 4 WHEN technique = 'distillation' THEN 768 ELSE len(v) * 4 END AS after FROM c)
SELECT id, technique, after::INTEGER AS bytes_after, round(len(v) * 4 / after::DOUBLE, 9) AS ratio, round(sqrt(len(v) * 4 / after::DOUBLE), 9) AS speedup, kept::DOUBLE AS explained, round(err, 9) AS error,
  round(greatest(0, least(1, err * 10 * CASE technique WHEN 'quantize4' THEN 1.5 ELSE 1 END + (1 - kept) * 0.5)), 9)::DOUBLE AS drop_estimate,
  CASE technique WHEN 'distillation' THEN NULL WHEN 'pca' THEN round(list_sum(list_transform(v[dims + 1:], lambda x: abs(x))) / len(v), 9) ELSE round(err, 9) END AS restored_error FROM x""")
def compression_dispatch(spark, sf_dir):
    """Every technique in turn, by id, there and back."""
    named = vectors(spark, sf_dir).withColumn("name", F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("id") % 6).cast("int")))
    out = cp.decompressed(cp.compressed(named))
    lost = V.mean(F.zip_with("v", "restored", lambda a, b: F.abs(a - b)))
    rounded = {n: F.round(c, 9) for n, c in {"ratio": F.col("ratio"), "speedup": F.col("speedup"), "error": F.col("error"), "drop_estimate": F.col("drop"), "restored_error": lost}.items()}
    return out.select("id", "technique", "bytes_after", "explained", *[c.alias(n) for n, c in rounded.items()])
