"""Queries over events that arrive late, out of order and more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.register import query, table
from quillon.sources.shared import shared_dir
from quillon.streaming import sinks as sk

#: Days of events that a run is given, and the watermark's delay.
DAYS, LATE = 10, "36 hours"
SINKS = {"errors": "event_type = 'error'", "large": "value > 40", "sampled": sk.chosen("event_id", 0.1)}


def delivered(events: DataFrame) -> DataFrame:
    """Deliveries (event, block): some events come three days late, some come twice, a day apart."""
    delays = F.when(F.col("event_id") % 17 == 0, F.array(F.lit(3))).when(F.col("event_id") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    days = events.withColumn("delay", F.explode(delays)).withColumn("day", F.unix_date(F.to_date("ts")) + F.col("delay"))
    return days.select("event_id", "ts", "event_type", "value", F.floor(F.col("day") / DAYS).alias("block"))


def streamed(spark, sf_dir) -> str:
    """The deliveries, run block by block: each run is a new start from the kept state. Returns the tables' folder."""
    at = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    delivered(events).write.partitionBy("block").parquet(f"{at}/all")
    all_rows = spark.read.parquet(f"{at}/all")
    blocks = sorted(r[0] for r in all_rows.select("block").distinct().collect())  # one for ten days
    schema = all_rows.drop("block").schema
    for n, b in enumerate(blocks):
        all_rows.filter(F.col("block") == b).drop("block").write.parquet(f"{at}/arrived/{n:06d}")
        sk.fan_out(spark.readStream.schema(schema).parquet(f"{at}/arrived/*"), f"{at}/out", SINKS, LATE)
    return f"{at}/out"


DELIVERED = f"""d AS (SELECT event_id, ts, event_type, value, floor((date_diff('day', DATE '1970-01-01', ts::DATE) + delay) / {DAYS}::DOUBLE) AS block FROM (
  SELECT *, unnest(CASE WHEN event_id % 17 = 0 THEN [3] WHEN event_id % 11 = 0 THEN [0, 1] ELSE [0] END) AS delay FROM events)),
mark AS (SELECT block, lag(top) OVER (ORDER BY block) AS upto FROM (SELECT block, max(max(ts)) OVER (ORDER BY block) AS top FROM d GROUP BY block)),
judged AS (SELECT d.*, coalesce(ts <= date_trunc('milliseconds', upto) - INTERVAL 36 HOUR, false) AS late FROM d JOIN mark USING (block)),
kept AS (SELECT DISTINCT event_id, ts, event_type, value FROM judged WHERE NOT late)"""


@query(f"""WITH {DELIVERED}
SELECT event_type, date_trunc('day', ts) AS day, count(*)::BIGINT AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most FROM kept GROUP BY ALL""")
def arrivals_daily(spark, sf_dir):
    """Days merged from the hourly aggregates that each batch has left."""
    days = sk.coarser(sk.merged(spark, streamed(spark, sf_dir), ["event_type"]), "day", ["event_type"])
    return days.select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 6).alias("total"), "least", "most")


@query(f"""WITH {DELIVERED}
SELECT 'errors' AS sink, event_id, value FROM kept WHERE event_type = 'error' UNION ALL SELECT 'large', event_id, value FROM kept WHERE value > 40
UNION ALL SELECT 'sampled', event_id, value FROM kept WHERE event_id * 2654435761 % 4294967296 < floor(0.1 * 4294967296)
UNION ALL SELECT 'late', count(*), NULL FROM judged WHERE late UNION ALL SELECT 'arrived', count(*), NULL FROM d""")
def arrivals_sinks(spark, sf_dir):
    """Every sink's rows, and as two more rows how many deliveries were late and how many there were."""
    at = streamed(spark, sf_dir)
    schema = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "event_type", "value").schema
    counts = sk.runs(spark, at).agg(F.sum("late").alias("late"), F.sum("arrived").alias("arrived"))
    counts = counts.select(F.explode(F.create_map(F.lit("late"), "late", F.lit("arrived"), "arrived")).alias("sink", "event_id"), F.lit(None).cast("double").alias("value"))
    for name in SINKS:
        counts = counts.unionByName(sk.sink(spark, at, name, schema).select(F.lit(name).alias("sink"), "event_id", "value"))
    return counts
