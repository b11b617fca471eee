"""Queries of the semantic service, the edge repository, recommendations and set rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.hashing import hash_embedding
from quillon.operators import composition as cm
from quillon.operators import dense, fusion
from quillon.operators import repository as rp
from quillon.plans.api import Config, parts
from quillon.plans.register import query, table
from quillon.plans.rules import SETS_SQL, sets

ASKED = [(1, "create small bolt"), (2, "red widget AND economy"), (3, "user data system"), (4, "steel ring")]


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, text string")


@query()
def api_find(spark, sf_dir):
    found = parts(spark, sf_dir).find(asked(spark))
    return found.withColumn("reasons", F.array_join("reasons", "; "))


@query()
def api_search_modes(spark, sf_dir):
    catalog, out = parts(spark, sf_dir), None
    for mode in ("keyword", "semantic", "hybrid"):
        found = catalog.search(asked(spark), mode, Config(limit=3)).withColumn("mode", F.lit(mode))
        out = found if out is None else out.unionByName(found)
    return out


@query()
def api_details(spark, sf_dir):
    ids = spark.createDataFrame([(3,), (100000000,)], "id long")
    return parts(spark, sf_dir).details(ids)


@query("SELECT p_brand AS category, count(*)::BIGINT AS n FROM part GROUP BY p_brand")
def api_count(spark, sf_dir):
    return parts(spark, sf_dir).count("category")


@query("SELECT count(*)::BIGINT AS items, count(*)::BIGINT AS vectors, 1.0::DOUBLE AS coverage, 'healthy' AS status FROM part")
def api_health(spark, sf_dir):
    return parts(spark, sf_dir).health()


def semantic_search(catalog, queries, k: int = 5):
    """Queries are expanded, every variant gets a vector, their mean is searched for; hits are ranked anew by names, categories and tags."""
    variants = queries.select("query_id", F.explode(T.expanded(F.col("text"))).alias("variant"))
    vectors = dense.vector_mean(variants.select("query_id", hash_embedding("variant").alias("v")), ["query_id"]).withColumnRenamed("mean", "v")
    found = dense.knn(catalog.vectors, vectors, 2 * k, least=0.1, self_pairs=True)
    items = catalog.items.withColumn("tags", F.split(F.lower("text"), " "))
    ranked = fusion.reranked(found.drop("rank").join(queries.withColumnRenamed("text", "query"), "query_id").join(items, "id"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query()
def semantic_service(spark, sf_dir):
    return semantic_search(parts(spark, sf_dir), asked(spark))


@query()
def semantic_contextual(spark, sf_dir):
    """The last search of a session is put behind the query."""
    before = spark.createDataFrame([(1, ["x", "blue bolt"]), (2, [])], "query_id long, previous array<string>")
    last = F.when(F.size("previous") > 0, F.element_at("previous", -1))
    joined = asked(spark).join(before, "query_id", "left").select("query_id", F.concat_ws(" ", "text", last).alias("text"))
    return semantic_search(parts(spark, sf_dir), joined)


@query()
def semantic_boolean(spark, sf_dir):
    return semantic_search(parts(spark, sf_dir), asked(spark).withColumn("text", T.without_operators(F.col("text"))))


@query(r"""WITH m AS (SELECT doc_id, text FROM documents WHERE text ILIKE '%idiot%' ORDER BY doc_id LIMIT 10),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 0) AS w FROM m),
s AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS s FROM w),
h AS (SELECT array_to_string(s, ' ') AS suggestion, doc_id, i FROM s WHERE len(list_filter(s, lambda x: contains(x, 'idiot'))) > 0),
o AS (SELECT suggestion, min(doc_id * 1000000 + i) AS p FROM h GROUP BY 1)
SELECT suggestion FROM o ORDER BY p LIMIT 5""")
def search_suggestions(spark, sf_dir):
    """Stretches around a word, from the first matching documents, each once, in order."""
    hits = table(spark, sf_dir, "documents").filter(F.col("text").ilike("%idiot%")).orderBy("doc_id").limit(10)
    found = hits.select("doc_id", F.posexplode(T.shingles(F.col("text"), T.strings(["idiot"]))).alias("at", "suggestion"))
    first = found.groupBy("suggestion").agg(F.min(F.struct("doc_id", "at")).alias("p"))
    return first.orderBy("p").limit(5).select("suggestion")


EDGE_SQL = """old AS (SELECT l_partkey AS src, l_suppkey AS dst, any_value('uses') AS type, round(avg(l_discount), 9) AS strength FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1, 2),
new AS (SELECT l_partkey AS src, l_suppkey * 25 AS dst, any_value('related') AS type, round(avg(l_tax), 9) AS strength FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2),
p AS (SELECT p_partkey AS id FROM part), sound AS (SELECT * FROM new WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p))"""


def edge_tables(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    mean = lambda c, kind: [F.lit(kind).alias("type"), F.round(F.avg(c), 9).alias("strength")]
    old = lines.filter("l_partkey % 2 = 0").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(*mean("l_discount", "uses"))
    new = lines.filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 25).alias("dst")).agg(*mean("l_tax", "related"))
    return old, new, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query(f"WITH {EDGE_SQL} SELECT * FROM old UNION ALL SELECT * FROM sound WHERE (src, dst) NOT IN (SELECT src, dst FROM old)")
def edges_saved(spark, sf_dir):
    return rp.saved(*edge_tables(spark, sf_dir))[0]


@query(f"""WITH {EDGE_SQL} SELECT reason, count(*)::BIGINT AS n FROM (SELECT 'unknown end' AS reason FROM new WHERE src NOT IN (SELECT id FROM p) OR dst NOT IN (SELECT id FROM p)
  UNION ALL SELECT 'already there' FROM sound WHERE (src, dst) IN (SELECT src, dst FROM old)) GROUP BY 1""")
def edges_rejected(spark, sf_dir):
    return rp.saved(*edge_tables(spark, sf_dir))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {EDGE_SQL} SELECT old.src, old.dst, coalesce(n.type, old.type) AS type, coalesce(n.strength, old.strength) AS strength FROM old LEFT JOIN new n ON n.src = old.src AND n.dst = old.dst")
def edges_updated(spark, sf_dir):
    old, new, _ = edge_tables(spark, sf_dir)
    return rp.updated(old, new)


@query(f"WITH {EDGE_SQL} SELECT * FROM old WHERE NOT (strength < 0.05)")
def edges_deleted(spark, sf_dir):
    return rp.deleted(edge_tables(spark, sf_dir)[0], F.col("strength") < 0.05)


@query(f"WITH {EDGE_SQL} SELECT o.src, o.dst, a.p_name AS src_name, b.p_name AS dst_name, strength FROM old o JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE strength >= 0.08 AND type = 'uses'")
def edges_with_names(spark, sf_dir):
    old, _, nodes = edge_tables(spark, sf_dir)
    return rp.with_ends(rp.found(old, kind="uses", least=0.08), nodes).select("src", "dst", "src_name", "dst_name", "strength")


ORDER = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(cm.ORDER))


@query(f"""WITH {SETS_SQL}, u AS (SELECT id, unnest(range(0, len(names))) AS pos, unnest(names) AS name FROM s), f AS (SELECT id, name, min(pos) AS pos FROM u GROUP BY ALL)
SELECT id, string_agg(name, ' > ' ORDER BY coalesce(CASE name {ORDER} END, 1000), pos) AS ordered FROM f GROUP BY id""")
def canonical_order(spark, sf_dir):
    return sets(spark, sf_dir).select("id", F.array_join(cm.ordered(F.col("names")), " > ").alias("ordered"))


COMPLEMENTS = "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in cm.COMPLEMENTS.items()) + "}"


@query(f"""WITH {SETS_SQL}, u AS (SELECT id, names, unnest(list_distinct(names)) AS name FROM s), c AS (SELECT id, names, name, unnest({COMPLEMENTS}[name]) AS missing FROM u)
SELECT id, name, missing FROM c WHERE NOT list_contains(names, missing)""")
def complementary(spark, sf_dir):
    return cm.complementary(sets(spark, sf_dir))


@query("""SELECT * FROM (VALUES ('object creation at scale', 'performance', 'Factory Method + Abstract Factory', 0.9::DOUBLE), ('object creation at scale', 'performance', 'Builder + Prototype', 0.8::DOUBLE),
  ('object creation at scale', 'performance', 'Flyweight + Object Pool', 0.8::DOUBLE), ('behavior coordination', 'scalability', 'Observer + Command', 0.9::DOUBLE),
  ('behavior coordination', 'scalability', 'Strategy + State', 0.85::DOUBLE), ('behavior coordination', 'scalability', 'Proxy + Observer', 0.75::DOUBLE)) t(problem, context, names, confidence)""")
def combination_suggestions(spark, sf_dir):
    rows = spark.createDataFrame([("object creation at scale", "performance"), ("behavior coordination", "scalability"), ("nothing", "")], "problem string, context string")
    return cm.combinations(rows)
