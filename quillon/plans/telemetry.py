"""Queries of telemetry, evaluation and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import quantiles as qt
from quillon.operators import telemetry as tm
from quillon.plans.fusion import FIXED, sparse_leg, SPARSE_SQL
from quillon.plans import common_sql as sql
from quillon.plans.register import query, table
from quillon.sources.shared import materialise


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


PERCENTILES = "list_sort(list(value))[(floor(count(value) * {0}) + 1)::INTEGER]"


@query(f"SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 9) AS mean, min(value) AS least, max(value) AS most, {PERCENTILES.format(0.5)} AS p50, {PERCENTILES.format(0.95)} AS p95, {PERCENTILES.format(0.99)} AS p99 FROM events GROUP BY event_type")
def percentiles_floor(spark, sf_dir):
    e = events(spark, sf_dir)
    base = e.groupBy("event_type").agg(F.round(F.avg("value"), 9).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return base.join(tm.ranked_percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "event_type")


@query("SELECT date_trunc('hour', ts) AS hour, count(*)::BIGINT AS n, round(count(*) / 3600::DOUBLE, 9) AS per_second, round(avg(value), 9) AS latency, round(avg((event_type = 'error')::INT), 9) AS error_rate, round(avg((event_type IN ('view', 'click'))::INT), 9) AS hit_rate FROM events GROUP BY 1")
def hourly_rates(spark, sf_dir):
    e = events(spark, sf_dir)
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("n"), F.round(F.count("*") / 3600, 9).alias("per_second"), F.round(F.avg("value"), 9).alias("latency"),
        share(F.col("event_type") == "error").alias("error_rate"), share(F.col("event_type").isin("view", "click")).alias("hit_rate"),
    ).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT count(*)::BIGINT AS n, round(avg(value), 9) AS latency FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def trailing_hour(spark, sf_dir):
    e = events(spark, sf_dir)
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last)).filter("ts >= last - interval 1 hour").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("latency"))


@query(r"SELECT query, n FROM (SELECT substr(trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')), 1, 50) AS query, count(*)::BIGINT AS n FROM part GROUP BY 1) ORDER BY n DESC, query LIMIT 20")
def usage_top20(spark, sf_dir):
    counted = table(spark, sf_dir, "part").groupBy(T.normalised_query(F.col("p_name")).alias("query")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "query").limit(20)


TRUTH = "truth AS (SELECT query_id, doc_id AS id FROM q, labels WHERE quality = 1 AND doc_id % 3 = query_id % 3)"
METRIC_SQL = f"""WITH {sql.BM25}, {SPARSE_SQL}, {TRUTH},
w AS (SELECT query_id, count(*) AS wanted FROM truth GROUP BY 1),
r AS (SELECT s.query_id, s.rank, s.score, (t.id IS NOT NULL)::INT AS rel, coalesce(wanted, 0) AS wanted FROM sparse s LEFT JOIN truth t ON t.query_id = s.query_id AND t.id = s.id LEFT JOIN w ON w.query_id = s.query_id),
x AS (SELECT query_id, rank, wanted, sum(rel) OVER u AS hits, sum(CASE WHEN rel = 1 THEN 1 ELSE score END / log2(rank + 1)) OVER u AS dcg, sum(1 / log2(rank + 1)) OVER u AS ideal,
  sum(rel / log2(rank + 1)) OVER u AS dcg_b, sum(CASE WHEN rank <= wanted THEN 1 / log2(rank + 1) ELSE 0 END) OVER u AS ideal_b FROM r WINDOW u AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
me AS (SELECT query_id, rank, hits / rank::DOUBLE AS precision, CASE WHEN wanted > 0 THEN hits / wanted::DOUBLE ELSE 0 END AS recall, dcg / ideal AS ndcg, CASE WHEN ideal_b > 0 THEN dcg_b / ideal_b ELSE 0 END AS ndcg_textbook FROM x)"""


def metrics(spark, sf_dir):
    from quillon.plans.lexical import batch

    labels = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    ranked = sparse_leg(spark, sf_dir)
    truth = ranked.select("query_id", "id").join(labels.distinct(), "id", "left_semi").filter("id % 3 = query_id % 3")
    # the relevant ones of a query are those with its remainder: three counts
    counts = labels.groupBy((F.col("id") % 3).alias("_m")).agg(F.count_distinct("id").alias("wanted"))
    wanted = batch(spark, sf_dir).select("query_id", (F.col("query_id") % 3).alias("_m")).join(F.broadcast(counts), "_m").drop("_m")
    return tm.prefix_metrics(ranked, truth, wanted=wanted)


@query(f"{METRIC_SQL} SELECT query_id, rank, round(precision, 9) AS precision, round(recall, 9) AS recall, round(ndcg, 9) AS ndcg, round(ndcg_textbook, 9) AS ndcg_textbook FROM me")
def precision_ndcg_at_k(spark, sf_dir):
    r = lambda c: F.round(c, 9).alias(c)
    return metrics(spark, sf_dir).select("query_id", "rank", r("precision"), r("recall"), r("ndcg"), r("ndcg_textbook"))


@query(f"{METRIC_SQL} SELECT query_id, round(sum(precision * recall) / count(*), 9) AS map_reference FROM me GROUP BY query_id")
def map_reference(spark, sf_dir):
    return tm.mean_average(metrics(spark, sf_dir)).withColumn("map_reference", F.round("map_reference", 9))


@query("WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (SELECT user_id, n, value / 2 AS q FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, (r.q + o.value) / 2 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, round(arg_max(q, n), 9) AS average FROM r GROUP BY user_id")
def quality_recurrence(spark, sf_dir):
    return tm.halving_average(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").withColumn("average", F.round("average", 9))


@query("SELECT user_id, event_id, before, event_type AS status, CASE WHEN event_type = 'error' THEN 'degraded' WHEN before = 'error' THEN 'recovered' ELSE 'changed' END AS kind FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type")
def status_transitions(spark, sf_dir):
    found = tm.transitions(events(spark, sf_dir), "user_id", "event_type", ["ts", "event_id"])
    return found.select("user_id", "event_id", "before", F.col("event_type").alias("status"), "kind")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def retention_kept(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.join(F.broadcast(e.agg(F.max("ts").alias("last")))).filter("ts >= last - interval 24 hours").select("event_id")


@query()
def event_sample(spark, sf_dir):
    return tm.sampled(events(spark, sf_dir), 0.1).select("event_id")


@query("""WITH v AS (SELECT count(*) AS v FROM embeddings), d AS (SELECT count(*) AS d FROM documents)
SELECT d::BIGINT AS documents, v::BIGINT AS vectors, round(v::DOUBLE / d, 9) AS coverage, CASE WHEN v::DOUBLE / d >= 0.9 THEN 'healthy' WHEN v::DOUBLE / d >= 0.5 THEN 'degraded' ELSE 'unhealthy' END AS status FROM v, d""")
def embedding_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"))
    both = d.join(F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"))))
    share = F.try_divide("vectors", "documents")
    status = F.when(share >= 0.9, "healthy").when(share >= 0.5, "degraded").otherwise("unhealthy")
    return both.withColumns({"status": status, "coverage": F.round(share, 9)})


@query("SELECT user_id % 7 AS node, count(*) FILTER (event_type = 'error')::BIGINT AS errors, CASE WHEN max((event_type = 'error')::INT) = 1 THEN 'unhealthy' WHEN max((event_type = 'purchase')::INT) = 1 THEN 'degraded' ELSE 'healthy' END AS overall FROM events WHERE value > 40 GROUP BY 1")
def health_overall(spark, sf_dir):
    """The worst status of a group counts."""
    severity = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    grouped = events(spark, sf_dir).filter("value > 40").groupBy((F.col("user_id") % 7).alias("node")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max(severity).alias("s"))
    return grouped.select("node", "errors", F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.col("s") + 1).alias("overall"))


@query(f"WITH {sql.BM25}, {SPARSE_SQL} SELECT query_id, round(stddev_pop(score) / avg(score), 9) AS cv, round(max(score) - min(score), 9) AS spread FROM sparse GROUP BY query_id HAVING avg(score) > 0")
def score_variability(spark, sf_dir):
    stats = sparse_leg(spark, sf_dir).groupBy("query_id").agg(F.stddev_pop("score").alias("s"), F.avg("score").alias("a"), F.max("score").alias("h"), F.min("score").alias("l"))
    return stats.filter("a > 0").select("query_id", F.round(F.col("s") / F.col("a"), 9).alias("cv"), F.round(F.col("h") - F.col("l"), 9).alias("spread"))


@query("SELECT event_type AS sql, count(*)::BIGINT AS n, round(sum(value), 6) AS total, round(avg(value), 9) AS mean, round(avg((value < 20)::INT), 9) AS hit_rate FROM events GROUP BY 1")
def statement_metrics(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("sql")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.avg((F.col("value") < 20).cast("int")), 9).alias("hit_rate")
    )


@query("SELECT user_id % 5 AS strategy, (count(DISTINCT event_type) / least(count(*), 10))::DOUBLE AS diversity, round(avg(least(value / 100, 1)), 9) AS relevance FROM events GROUP BY 1")
def evaluator_metrics(spark, sf_dir):
    return events(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("strategy")).agg(
        (F.count_distinct("event_type") / F.least(F.count("*"), F.lit(10))).alias("diversity"), F.round(F.avg(F.least(F.col("value") / 100, F.lit(1.0))), 9).alias("relevance")
    )


@query("SELECT query_pattern, dense_weight, sparse_weight FROM (SELECT substr(lower(p_name), 1, 50) AS query_pattern, p_partkey, round(CASE WHEN p_size % 2 = 0 THEN 0.6 ELSE 0.54 END, 9)::DOUBLE AS dense_weight, round(CASE WHEN p_size % 2 = 0 THEN 0.4 ELSE 0.44 END, 9)::DOUBLE AS sparse_weight, row_number() OVER (PARTITION BY substr(lower(p_name), 1, 50) ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1")
def adaptive_weights(spark, sf_dir):
    """Feedback by query: good keeps the weights, bad moves them by a tenth; the last one counts."""
    from quillon.operators.catalog import keep_first

    good = F.col("p_size") % 2 == 0
    rows = table(spark, sf_dir, "part").select(
        F.substring(F.lower("p_name"), 1, 50).alias("query_pattern"), "p_partkey", F.round(F.when(good, 0.6).otherwise(0.6 * 0.9), 9).alias("dense_weight"), F.round(F.when(good, 0.4).otherwise(0.4 * 1.1), 9).alias("sparse_weight")
    )
    return keep_first(rows, ["query_pattern"], [F.desc("p_partkey")]).drop("p_partkey")


@query("SELECT lower(text) AS query, CASE WHEN len(string_split(text, ' ')) <= 3 THEN 'specific' WHEN contains(lower(text), 'how') OR contains(lower(text), 'what') OR contains(lower(text), 'explain') THEN 'exploratory' ELSE 'balanced' END AS kind FROM (VALUES " + ", ".join(f"('{t}')" for _, t in FIXED) + ") t(text)")
def query_kinds(spark, sf_dir):
    fixed = spark.createDataFrame([(t,) for _, t in FIXED], "text string")
    return fixed.select(F.lower("text").alias("query"), T.query_kind(F.col("text")).alias("kind"))


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
SELECTED = "list_sort(list({0}))[(floor(count({0}) * {1}) + 1)::INTEGER]"


@query(f"SELECT l_returnflag AS flag, count(*)::BIGINT AS n, {', '.join(f'{SELECTED.format('l_extendedprice', p)} AS {n}' for n, p in SHARES.items())} FROM lineitem GROUP BY 1")
def percentiles_ranges(spark, sf_dir):
    """Exact percentiles of three large keys; ranges are ranked, not keys."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return qt.exact_percentiles(rows, ["flag"], "l_extendedprice", SHARES)


@query("""SELECT event_type, count(*)::BIGINT AS n, true AS p50_near, true AS p95_near, true AS p99_near, true AS distinct_near FROM events GROUP BY 1""")
def sketched_report(spark, sf_dir):
    """Whether percentiles and distinct users merged from daily sketches are as near to the exact ones as is stated (ranks 2 %, counts 5 %)."""
    e = events(spark, sf_dir)
    daily = materialise(qt.sketched(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value", "user_id"), "sketches")
    found = qt.estimated(qt.merged(daily, ["event_type"]), SHARES)
    near = e.join(found, "event_type").groupBy("event_type").agg(
        F.max("n").alias("n"), *[(qt.rank_error(F.col(name), F.col("value"), p) <= 0.02).alias(f"{name}_near") for name, p in SHARES.items()],
        (F.abs(F.max("distinct") / F.count_distinct("user_id") - 1) <= 0.05).alias("distinct_near"),
    )
    return near
