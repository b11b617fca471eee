"""Relational queries: filters, joins, counts, integrity. Parts stand for the catalog, orders and lines for what hangs on it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import catalog as ct
from quillon.plans.register import query, table


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_partkey = 42").select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 17)")
def name_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.join(F.broadcast(part.filter("p_partkey = 17").select("p_name")), "p_name", "left_semi").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part WHERE p_brand = 'Brand#12'")
def category_sorted(spark, sf_dir):
    found = table(spark, sf_dir, "part").filter("p_brand = 'Brand#12'")
    return found.select("p_partkey", "p_name", F.row_number().over(Window.orderBy("p_name", "p_partkey")).alias("place"))


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%bolt%' OR p_type ILIKE '%small%'")
def ilike_search(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%bolt%") | F.col("p_type").ilike("%small%")).select("p_partkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_partkey NOT IN (1, 2, 3, 5, 8)")
def in_and_not_in(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.filter(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") & ~F.col("p_partkey").isin(1, 2, 3, 5, 8)).select("p_partkey", "p_brand")


@query("SELECT p_partkey FROM part WHERE len(list_intersect(string_split(p_type, ' '), ['SMALL', 'PROMO'])) > 0")
def tags_overlap(spark, sf_dir):
    tags = F.split("p_type", " ")
    return table(spark, sf_dir, "part").filter(F.arrays_overlap(tags, F.array(F.lit("SMALL"), F.lit("PROMO")))).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_discount >= 0.05")
def edges_filter_strength(spark, sf_dir):
    kept = ct.all_of(F.col("l_returnflag") == "R", None, F.col("l_quantity") >= 45, F.col("l_discount") >= 0.05)
    return table(spark, sf_dir, "lineitem").filter(kept).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7")
def either_end(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_partkey = 7 OR l_suppkey = 7").select("l_orderkey", "l_linenumber")


@query("SELECT p_brand AS category, count(*)::BIGINT AS n FROM part GROUP BY p_brand")
def category_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS category, p_size AS size, count(*)::BIGINT AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
def category_rollup(spark, sf_dir):
    return table(spark, sf_dir, "part").rollup(F.col("p_brand").alias("category"), F.col("p_size").alias("size")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT p_brand)::BIGINT AS categories FROM part")
def count_distinct_category(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count_distinct("p_brand").alias("categories"))


@query("SELECT (SELECT count(*) FROM part)::BIGINT AS items, (SELECT count(DISTINCT p_brand) FROM part)::BIGINT AS categories, (SELECT count(*) FROM lineitem)::BIGINT AS edges, (SELECT count(*) FROM embeddings)::BIGINT AS vectors")
def catalog_stats(spark, sf_dir):
    items = table(spark, sf_dir, "part").agg(F.count("*").alias("items"), F.count_distinct("p_brand").alias("categories"))
    edges = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("edges"))
    return items.join(F.broadcast(edges)).join(F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"))))


@query("SELECT 'brand' AS kind, p_brand AS name, count(*)::BIGINT AS n FROM part GROUP BY p_brand UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang")
def seeder_stats(spark, sf_dir):
    brands = table(spark, sf_dir, "part").groupBy(F.lit("brand").alias("kind"), F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return brands.unionByName(table(spark, sf_dir, "documents").groupBy(F.lit("lang").alias("kind"), F.col("lang").alias("name")).agg(F.count("*").alias("n")))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY event_type")
def invalid_type_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(~F.col("event_type").isin("view", "click", "purchase")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS src, l_suppkey AS dst, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_orphans(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join_exists(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 48")
def edge_two_way_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 48")
    joined = lines.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("SELECT p_partkey, coalesce(round(avg(l_quantity), 6), 0) AS score FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY p_partkey")
def left_join_default(spark, sf_dir):
    """A part without returned lines has score 0."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.avg("l_quantity").alias("a"))
    joined = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select("p_partkey", F.coalesce(F.round("a", 6), F.lit(0.0)).alias("score"))


@query("""SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_extendedprice DESC, l_linenumber), '') AS lines FROM orders LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) l ON l_orderkey = o_orderkey AND n <= 3 GROUP BY o_orderkey""")
def top3_per_parent(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    found = ct.first_children(orders, lines, "l_orderkey", [F.desc("l_extendedprice"), "l_linenumber"], 3, ["l_linenumber", "l_partkey"])
    said = F.transform("children", lambda c: F.concat_ws(":", c["l_linenumber"].cast("string"), c["l_partkey"].cast("string")))
    return found.select(F.col("l_orderkey").alias("o_orderkey"), F.array_join(said, ",").alias("lines"))


@query("""SELECT p_partkey, alternative, place FROM (SELECT a.p_partkey, b.p_partkey AS alternative, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_retailprice, b.p_partkey) AS place
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey) WHERE place <= 3""")
def alternatives_top3(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    # without the part itself, its first three are among the group's first four
    first = part.withColumn("_r", F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_retailprice", "p_partkey"))).filter("_r <= 4").drop("_r")
    pairs = part.drop("p_retailprice").join(first.withColumnRenamed("p_partkey", "alternative"), ["p_brand", "p_size"]).filter("p_partkey <> alternative")
    order = Window.partitionBy("p_partkey").orderBy("p_retailprice", "alternative")
    return pairs.withColumn("place", F.row_number().over(order)).filter("place <= 3").select("p_partkey", "alternative", "place")


EDGES = "e AS (SELECT l_partkey AS src, l_suppkey * 30 AS dst FROM lineitem)"


def edges(spark, sf_dir):
    """Lines as links between parts; many ends are no part."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 30).alias("dst"))


@query(f"WITH {EDGES} SELECT src, dst, 'dst' AS lost FROM e WHERE dst NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT src, dst, 'src' FROM e WHERE src NOT IN (SELECT p_partkey FROM part)")
def broken_references(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return ct.broken_edges(edges(spark, sf_dir), nodes).withColumnRenamed("end", "lost")


@query(f"WITH {EDGES} SELECT DISTINCT src, dst FROM e WHERE src <> dst AND src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part)")
def integrity_fix(spark, sf_dir):
    return ct.sound_edges(edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query(f"""WITH {EDGES}, p AS (SELECT p_partkey AS id FROM part)
SELECT 'broken' AS issue, count(*)::BIGINT AS n FROM e WHERE dst NOT IN (SELECT id FROM p) UNION ALL SELECT 'self', count(*) FROM e WHERE src = dst
UNION ALL SELECT 'duplicate', count(*) FROM (SELECT src, dst FROM e GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'orphan', count(*) FROM p WHERE id NOT IN (SELECT src FROM e)""")
def integrity_report(spark, sf_dir):
    e, p = edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    count = lambda name, df: df.agg(F.lit(name).alias("issue"), F.count("*").alias("n"))
    parts = [
        count("broken", e.join(p, F.col("dst") == F.col("id"), "left_anti")), count("self", e.filter("src = dst")),
        count("duplicate", e.groupBy("src", "dst").count().filter("count > 1")), count("orphan", p.join(e, F.col("id") == F.col("src"), "left_anti")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


OLD_NEW = "old AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 2 = 0), new AS (SELECT p_partkey AS id, upper(p_name) AS name FROM part WHERE p_partkey % 3 = 0)"


def old_new(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return part.filter("id % 2 = 0"), part.filter("id % 3 = 0").withColumn("name", F.upper("name"))


@query(f"WITH {OLD_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def insert_missing(spark, sf_dir):
    return ct.add_missing(*old_new(spark, sf_dir), "id")


@query(f"WITH {OLD_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def upsert_replace(spark, sf_dir):
    return ct.replace_by_key(*old_new(spark, sf_dir), "id")


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1")
def keep_first_edge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return ct.keep_first(lines, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT r_name, n_name, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def hierarchy_counts(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT p_brand AS category, count(*) FILTER (p_size < 17)::BIGINT AS low, count(*) FILTER (p_size BETWEEN 17 AND 33)::BIGINT AS medium, count(*) FILTER (p_size > 33)::BIGINT AS high FROM part GROUP BY p_brand""")
def category_pivot(spark, sf_dir):
    level = F.when(F.col("p_size") < 17, "low").when(F.col("p_size") <= 33, "medium").otherwise("high")
    return table(spark, sf_dir, "part").withColumn("level", level).groupBy(F.col("p_brand").alias("category")).pivot("level", ["low", "medium", "high"]).count().na.fill(0)


@query("SELECT event_id FROM events WHERE ts + INTERVAL 1 HOUR * (floor(value)::BIGINT % 48) > TIMESTAMP '2024-01-20'")
def live_entries(spark, sf_dir):
    """Entries whose time to live, in hours, has not run out at a given moment."""
    ends = F.expr("cast(ts as timestamp) + make_interval(0, 0, 0, 0, cast(floor(value) as int) % 48, 0, 0)")
    return table(spark, sf_dir, "events").filter(ends > F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("SELECT p_partkey, p_name || ' fits ' || lower(p_type) || '.' AS fit, coalesce(CASE WHEN p_size > 25 THEN 'High' END, 'Medium') AS complexity, array_to_string(list_sort(string_split(p_type, ' ')), ',') AS tags FROM part")
def recommendation_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.format_string("%s fits %s.", "p_name", F.lower("p_type")).alias("fit"), F.coalesce(F.when(F.col("p_size") > 25, "High"), F.lit("Medium")).alias("complexity"),
        F.array_join(F.array_sort(F.split("p_type", " ")), ",").alias("tags"),
    )


@query("SELECT lower(p_brand) AS name FROM part UNION SELECT lower(n_name) FROM nation EXCEPT SELECT 'france'")
def set_operations(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("name")).union(table(spark, sf_dir, "nation").select(F.lower("n_name"))).distinct()
    return names.subtract(table(spark, sf_dir, "nation").filter("lower(n_name) = 'france'").select(F.lower("n_name").alias("name")))
