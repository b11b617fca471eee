"""Streams into several tables: late rows, repeated deliveries, restarts and batches run again."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from quillon.streaming import sinks as sk

SCHEMA = "event_id long, ts timestamp, event_type string, value double"
DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SINKS = {"bad": "event_type = 'error'", "all": "true"}


def event(n, hours, kind="view", value=1.0):
    return (n, None if hours is None else DAY + dt.timedelta(hours=hours), kind, value)


def arrive(spark, at, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{at}/in/{n}")
    sk.fan_out(spark.readStream.schema(SCHEMA).parquet(f"{at}/in/*"), f"{at}/out", SINKS, "10 hours")


def state(spark, at):
    schema = spark.createDataFrame([], SCHEMA).schema
    out = {n: sorted(r.event_id for r in sk.sink(spark, f"{at}/out", n, schema).collect()) for n in SINKS}
    windows = {(r.event_type, r.start and r.start.timestamp()): (r.n, r.total, r.least, r.most) for r in sk.merged(spark, f"{at}/out", ["event_type"]).collect()}
    counts = sk.runs(spark, f"{at}/out").agg(F.sum("arrived"), F.sum("late")).first()
    return out, windows, tuple(counts)


def test_late_and_repeated_rows_across_restarts(spark, tmp_path):
    at = str(tmp_path)
    arrive(spark, at, 0, [event(1, 0), event(2, 0.5, "error", 5.0), event(3, 20)])
    arrive(spark, at, 1, [event(4, 9), event(5, 10), event(6, 11, value=3.0), event(3, 20), event(7, 0.2), event(8, None)])  # the mark stands at hour 10
    arrive(spark, at, 2, [event(9, 11.5, value=-2.0)])
    out, windows, counts = state(spark, at)
    assert out == {"bad": [2], "all": [1, 2, 3, 6, 8, 9]}
    hour = lambda h: (DAY + dt.timedelta(hours=h)).timestamp()
    assert windows[("view", hour(11))] == (2, 1.0, -2.0, 3.0)  # of two batches
    assert windows[("view", None)][0] == 1 and windows[("error", hour(0))] == (1, 5.0, 5.0, 5.0)
    assert counts == (10, 3)  # 4, 5 and 7 were late
    days = {r.event_type: r.n for r in sk.coarser(sk.merged(spark, f"{at}/out", ["event_type"]).filter("start is not null"), "day", ["event_type"]).collect()}
    assert days == {"view": 4, "error": 1}


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    at = str(tmp_path)
    arrive(spark, at, 0, [event(1, 0), event(2, 1, "error")])
    before = state(spark, at)
    for f in (Path(at) / "out/state/commits").iterdir():  # as if the driver was lost before a batch was noted
        if f.name.strip(".").split(".")[0] != "metadata":
            f.unlink()
    sk.fan_out(spark.readStream.schema(SCHEMA).parquet(f"{at}/in/*"), f"{at}/out", SINKS, "10 hours")
    assert state(spark, at)[:2] == before[:2]


def test_nothing_arrived(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    assert sk.sink(spark, str(tmp_path), "all", schema).count() == 0
