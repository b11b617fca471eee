"""Queries over catalogs that are read from files into the versioned store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.plans.register import query, table
from quillon.sources.seed import Seed
from quillon.sources.shared import shared_dir

#: Entries that a file holds, and buckets of the store.
A_FILE, BUCKETS = 500, 16


def files(parts, at: str, name: str) -> str:
    """JSON files of entries made from parts (key, name, category, description); returns their folder."""
    link = lambda to, kind: F.struct(to.alias("targetPatternId"), F.lit(kind).alias("type"), F.lit(0.5).alias("strength"))
    next_one = F.col("key") + 1
    entry = F.struct(
        F.concat(F.lit("part-"), "key").alias("id"), "name", "category", "description", F.array("category").alias("tags"),
        F.when(F.col("key") % 3 == 0, F.array(link(F.concat(F.lit("part-"), next_one), "related"), link(F.lit("nowhere"), "uses")))
        .when(F.col("key") % 3 == 1, F.array(link(F.concat(F.lit("Part "), next_one), "uses"))).alias("relationships"),
    )
    lines = parts.groupBy(F.floor(F.col("key") / A_FILE)).agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("patterns"))).alias("value"))
    lines.select("value").write.option("maxRecordsPerFile", 1).text(f"{at}/{name}")
    return f"{at}/{name}"


def seeded(spark, sf_dir) -> Seed:
    """Three loads: all parts; those of brands 1x again, newer; sizes under ten once more, but older than both."""
    at = f"{shared_dir(spark)}/seed-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.concat(F.lit("Part "), "p_partkey").alias("name"), F.col("p_type").alias("category"),
        F.when(F.col("p_size") != 13, F.col("p_name")).alias("description"), "p_brand", "p_size",
    )
    again = p.filter(F.col("p_brand").startswith("Brand#1")).withColumn("description", F.concat("description", F.lit(" (new)")))
    stale = p.filter("p_size < 10").withColumn("description", F.lit("stale"))
    seed = Seed(spark, f"{at}/store", BUCKETS)
    for n, (rows, version) in enumerate(((p, 2), (again, 3), (stale, 1))):
        seed.load(files(rows, at, f"files-{n}"), version)
    return seed


GOOD = """p AS (SELECT p_partkey AS key, p_type AS category, p_name || CASE WHEN p_brand LIKE 'Brand#1%' THEN ' (new)' ELSE '' END AS description,
  CASE WHEN p_brand LIKE 'Brand#1%' THEN 3 ELSE 2 END::BIGINT AS version FROM part WHERE p_size <> 13)"""


@query(f"WITH {GOOD} SELECT 'part-' || key AS id, 'Part ' || key AS name, category, description, 'Medium' AS complexity, category AS tags, version FROM p")
def seed_entries(spark, sf_dir):
    """The store after all loads: the newest version of every entry that is whole."""
    return seeded(spark, sf_dir).entries.read().drop("file")


@query(f"""WITH {GOOD} SELECT 'part-' || p.key AS src, 'part-' || t.key AS dst, CASE p.key % 3 WHEN 0 THEN 'related' ELSE 'uses' END AS type, 0.5::DOUBLE AS strength, p.version
FROM p JOIN p t ON t.key = p.key + 1 WHERE p.key % 3 IN (0, 1)""")
def seed_links(spark, sf_dir):
    """The links of the store: by id, else by name; those to nowhere are gone."""
    return seeded(spark, sf_dir).links.read().drop("id")


@query("SELECT count(*)::BIGINT AS entries, count(DISTINCT p_partkey // 500)::BIGINT AS files FROM part WHERE p_size <> 13")
def seed_files(spark, sf_dir):
    """How many entries the store has, and from how many files of the first load they came."""
    # a part that was loaded again comes from the later file; the first load has them all
    seed = seeded(spark, sf_dir)
    return seed.entries.read(0).agg(F.count("*").alias("entries"), F.count_distinct("file").alias("files"))
