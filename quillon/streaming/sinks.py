"""One stream into several tables: late rows dropped and counted, repeated deliveries taken once, aggregates that merge.

A run takes what has arrived since the last one and stops; the next run goes on
from the kept state. Rows older than the watermark, and rows with an id that
was seen while its time was within the watermark, do not pass. What passes
goes, a folder for each micro-batch, to every sink and to a table of partial
aggregates by window. A batch that is run again overwrites its own folders, so
that nothing counts twice; ``runs`` has those runs alone that came to their end. Aggregates are merged when they are read, by sums,
least and greatest; no state is kept for them.

Rows without a time or an id pass and belong to no window (a null start).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.shared import exists

_RUN = "run long, arrived long, late long"


def chosen(key: str, rate: float) -> str:
    """A predicate for a share of the rows by a multiplicative hash of a whole number, the same ones on every run."""
    return f"pmod(`{key}` * 2654435761L, 4294967296L) < {int(rate * 2**32)}L"


def partials(rows: DataFrame, window: str, keys: list[str]) -> DataFrame:
    """(*keys, start, n, total, least, most) of ``value`` by window."""
    start = F.window("ts", window)["start"].alias("start")
    timed = rows.filter("ts is not null").select(*keys, start, "value")
    untimed = rows.filter("ts is null").select(*keys, F.lit(None).cast("timestamp").alias("start"), "value")
    return timed.unionByName(untimed).groupBy(*keys, "start").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def fan_out(stream: DataFrame, at: str, sinks: dict[str, str], late: str = "36 hours", window: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> None:
    """Runs (event_id, ts, value, *keys) to its present end, into the tables under ``at``.

    ``sinks``: a predicate in SQL for each table, the rows that it takes. Memory: ids of the time within the watermark.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, takes in sinks.items():
                batch.filter(takes).write.mode("overwrite").parquet(f"{at}/sinks/{name}/batch={number}")
            partials(batch, window, list(keys)).write.mode("overwrite").parquet(f"{at}/partials/batch={number}")
        finally:
            batch.unpersist()

    passing = stream.withWatermark("ts", late).dropDuplicates(["event_id", "ts"])
    run = passing.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    seen = {}
    while True:  # progress is kept for some batches only, hence looked at while the run lasts
        ended = run.awaitTermination(1)
        seen |= {p["batchId"]: p for p in run.recentProgress if p["numInputRows"] or p["stateOperators"]}
        if ended:
            break
    arrived = sum(p["numInputRows"] for p in seen.values())
    dropped = sum(o["numRowsDroppedByWatermark"] for p in seen.values() for o in p["stateOperators"])
    last = max(seen, default=-1)
    if arrived:
        spark.createDataFrame([(last, arrived, dropped)], _RUN).coalesce(1).write.mode("overwrite").parquet(f"{at}/runs/run={last}")


def sink(spark: SparkSession, at: str, name: str, schema: T.StructType) -> DataFrame:
    """The rows that a sink has taken; none before the first run."""
    path = f"{at}/sinks/{name}"
    return spark.read.schema(schema).parquet(path).drop("batch") if exists(spark, path) else spark.createDataFrame([], schema)


def merged(spark: SparkSession, at: str, keys: list[str]) -> DataFrame:
    """The aggregates of all batches, merged: (*keys, start, n, total, least, most)."""
    parts = spark.read.parquet(f"{at}/partials")
    return parts.groupBy(*keys, "start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def coarser(windows: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """Windows of a longer unit (day, month) from kept ones, without the events."""
    return windows.groupBy(*keys, F.date_trunc(unit, "start").alias("start")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def runs(spark: SparkSession, at: str) -> DataFrame:
    """(run, arrived, late): rows that each run was given, and those it dropped as late."""
    return spark.read.schema(_RUN).parquet(f"{at}/runs")
