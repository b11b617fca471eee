"""Queries of ingestion and validation: parts stand for catalog entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.sources import catalog_json as cj
from quillon.plans.register import query, table


def entries(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.when(F.col("p_partkey") % 5 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))).alias("id"),
        F.when(F.col("p_size") != 7, F.col("p_name")).alias("name"), F.col("p_brand").alias("category"), F.when(F.col("p_size") != 9, F.col("p_type")).otherwise(" ").alias("description"),
        F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Very High", "Odd")]), F.col("p_size") % 5 + 1).alias("complexity"),
    )


ENTRY_SQL = """e AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN upper(replace(p_name, ' ', '-')) ELSE replace(p_name, ' ', '-') || '-' || p_partkey END AS id, CASE WHEN p_size <> 7 THEN p_name END AS name, p_brand AS category,
  CASE WHEN p_size <> 9 THEN p_type ELSE ' ' END AS description, ['Low', 'Medium', 'High', 'Very High', 'Odd'][(p_size % 5 + 1)::INTEGER] AS complexity FROM part)"""


@query(f"""WITH {ENTRY_SQL} SELECT id, f AS fault FROM (SELECT id, unnest(list_filter([CASE WHEN name IS NULL OR trim(name) = '' THEN 'name is required' END, CASE WHEN trim(description) = '' THEN 'description is required' END,
  CASE WHEN NOT regexp_full_match(id, '[a-z][a-z0-9-]*') THEN 'id must be lower-case letters, digits and hyphens' END, CASE WHEN complexity = 'Odd' THEN 'complexity is not a known level' END], lambda x: x IS NOT NULL)) AS f FROM e)""")
def validation_faults(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.select("id", F.explode(cj.faults(e)).alias("f")).select("id", F.concat_ws(" ", "f.field", "f.message").alias("fault"))


@query(f"WITH {ENTRY_SQL} SELECT name IS NOT NULL AS sound, count(*)::BIGINT AS n FROM e GROUP BY 1")
def required_fields(spark, sf_dir):
    good, bad = cj.required(entries(spark, sf_dir))
    return good.groupBy(F.lit(True).alias("sound")).agg(F.count("*").alias("n")).unionByName(bad.groupBy(F.lit(False).alias("sound")).agg(F.count("*").alias("n")))


@query(f"""WITH {ENTRY_SQL}, f AS (SELECT *, list_filter([CASE WHEN name IS NULL OR trim(name) = '' THEN '- name is required' END, CASE WHEN trim(description) = '' THEN '- description is required' END,
  CASE WHEN NOT regexp_full_match(id, '[a-z][a-z0-9-]*') THEN '- id must be lower-case letters, digits and hyphens' END, CASE WHEN complexity = 'Odd' THEN '- complexity is not a known level' END], lambda x: x IS NOT NULL) AS l FROM e)
SELECT id, len(l) = 0 AS valid, CASE WHEN len(l) = 0 THEN 'valid' ELSE array_to_string(l, chr(10)) END AS text FROM f""")
def validation_report(spark, sf_dir):
    return cj.report(entries(spark, sf_dir))


@query("SELECT len(embedding) = 64 AS sound, count(*)::BIGINT AS n FROM embeddings GROUP BY 1")
def embedding_dimensions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy((F.size("embedding") == 64).alias("sound")).agg(F.count("*").alias("n"))


@query()
def rebuilt_embeddings(spark, sf_dir):
    """Vectors from name and description; the longest weight and the norm are shown."""
    from quillon.functions.hashing import hash_embedding

    text = F.concat_ws(" ", "p_name", "p_type")
    made = table(spark, sf_dir, "part").select("p_partkey", hash_embedding(text).alias("v"))
    return made.select("p_partkey", F.round(F.array_max("v"), 9).alias("most"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@query("SELECT p_brand AS category, to_json(list(p_partkey ORDER BY p_partkey))::VARCHAR AS ids FROM part GROUP BY p_brand")
def category_resource(spark, sf_dir):
    grouped = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category")).agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    return grouped.select("category", F.to_json("ids").alias("ids"))


@query("SELECT p_brand AS user_id, to_json(map_from_entries(list((p_type, n::VARCHAR) ORDER BY p_type)))::VARCHAR AS preferences FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def preference_maps(spark, sf_dir):
    counted = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").count()
    entries_ = F.array_sort(F.collect_list(F.struct("p_type", F.col("count").cast("string").alias("n"))))
    return counted.groupBy(F.col("p_brand").alias("user_id")).agg(F.to_json(F.map_from_entries(entries_)).alias("preferences"))
