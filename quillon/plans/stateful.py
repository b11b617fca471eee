"""Queries over event streams and state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans.register import query, table
from quillon.streaming import events as ev
from quillon.streaming import machines as mc


def keyed(spark, sf_dir):
    """(key, ts, event_id, event)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("event"))


ORDERED = "o AS (SELECT user_id, event_id, event_type, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
BUCKET_SQL = f"""WITH RECURSIVE {ORDERED},
r AS (SELECT user_id, 0::BIGINT AS n, 5::BIGINT AS tokens, t AS since, NULL::BIGINT AS event_id, NULL::VARCHAR AS verdict FROM o WHERE n = 1
  UNION ALL SELECT user_id, n, have - (have > 0)::INT, CASE WHEN back > 0 THEN t ELSE since END, event_id, CASE WHEN have > 0 THEN 'allowed' ELSE 'limited' END FROM (
    SELECT x.*, CASE WHEN back > 0 THEN least(5, tokens + back) ELSE tokens END AS have FROM (
      SELECT o.user_id, o.n, o.t, o.event_id, r.tokens, r.since, floor((o.t - r.since) / 60000::DOUBLE * (1 / 60::DOUBLE))::BIGINT AS back FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) x))
SELECT user_id::VARCHAR AS key, event_id, verdict, tokens::DOUBLE AS level FROM r WHERE n > 0"""
BREAKER_SQL = f"""WITH RECURSIVE {ORDERED},
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'closed' AS mode, 0::BIGINT AS failed, 0::BIGINT AS good, 0::BIGINT AS retry, NULL::BIGINT AS event_id, NULL::VARCHAR AS verdict FROM o
  UNION ALL SELECT user_id, n,
    CASE WHEN rejected THEN 'open' WHEN ok AND m = 'half_open' AND good >= 2 THEN 'closed' WHEN ok THEN m WHEN m = 'half_open' OR failed >= 1 THEN 'open' ELSE m END,
    CASE WHEN rejected THEN failed WHEN ok AND (m = 'closed' OR good >= 2) THEN 0 WHEN ok THEN failed ELSE failed + 1 END,
    CASE WHEN rejected THEN good WHEN ok THEN good + 1 WHEN m = 'half_open' THEN 0 ELSE good END,
    CASE WHEN rejected THEN retry WHEN ok AND m = 'half_open' AND good >= 2 THEN 0 WHEN NOT ok AND (m = 'half_open' OR failed >= 1) THEN t + 3600000 ELSE retry END, event_id,
    CASE WHEN rejected THEN 'rejected' WHEN ok AND m = 'half_open' AND good >= 2 THEN 'closed' WHEN ok THEN m WHEN m = 'half_open' OR failed >= 1 THEN 'open' ELSE m END FROM (
    SELECT o.user_id, o.n, o.t, o.event_id, o.event_type <> 'error' AS ok, r.failed, r.good, r.retry, r.mode = 'open' AND o.t < r.retry AS rejected, CASE WHEN r.mode = 'open' THEN 'half_open' ELSE r.mode END AS m
    FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1))
SELECT user_id::VARCHAR AS key, event_id, verdict, failed::DOUBLE AS level FROM r WHERE n > 0"""


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def streamed_hourly(spark, sf_dir):
    """Tumbling windows of an hour, by a stream run to its end."""
    counted = ev.windowed(ev.event_stream(spark, sf_dir), "1 hour", ["event_type"])
    rows = ev.run_once(counted, "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


@query(BUCKET_SQL)
def token_bucket(spark, sf_dir):
    return mc.replay(keyed(spark, sf_dir), mc.TokenBucket(burst=5, per_minute=1))


@query(BREAKER_SQL)
def circuit_breaker(spark, sf_dir):
    return mc.replay(keyed(spark, sf_dir), mc.CircuitBreaker(failures=2, recovery=3_600_000))


@query()
def cache_replay(spark, sf_dir):
    return mc.replay(keyed(spark, sf_dir), mc.Cache(size=3, ttl=86_400_000))


@query()
def cache_hit_rates(spark, sf_dir):
    replayed = mc.replay(keyed(spark, sf_dir), mc.Cache(size=3, ttl=86_400_000))
    return replayed.groupBy("key").agg(F.round(F.avg((F.col("verdict") == "hit").cast("int")), 9).alias("hit_rate"))


@query(BREAKER_SQL)
def streamed_breaker(spark, sf_dir):
    """The breaker with its state kept by the stream."""
    e = ev.event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "ts", "event_id", F.col("event_type").alias("event"))
    return ev.run_once(mc.stream(e, mc.CircuitBreaker(failures=2, recovery=3_600_000)))


@query("""WITH w AS (SELECT *, unnest([0, 1]) AS k FROM events), x AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, value FROM w)
SELECT start, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM x GROUP BY start""")
def streamed_sliding(spark, sf_dir):
    """Windows of an hour every 30 minutes."""
    rows = ev.run_once(ev.windowed(ev.event_stream(spark, sf_dir), "1 hour", [], slide="30 minutes"), "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))


@query()
def cache_levels(spark, sf_dir):
    """Hits by level of a small cache before a larger one, which is asked for what the first misses."""
    first = mc.replay(keyed(spark, sf_dir), mc.Cache(size=2, ttl=86_400_000))
    missed = keyed(spark, sf_dir).join(first.filter("verdict = 'miss'").select("event_id"), "event_id", "left_semi").select("key", "ts", "event_id", "event")
    second = mc.replay(missed, mc.Cache(size=5, ttl=604_800_000))
    share = lambda df, level: df.agg(F.lit(level).alias("level"), F.count("*").alias("asked"), F.count_if(F.col("verdict") == "hit").alias("hits"))
    return share(first, 1).unionByName(share(second, 2))
