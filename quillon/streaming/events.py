"""Event streams: replayed tables, windowed counts, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.shared import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream; its time is cast, as a watermark needs a timestamp with a zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, keys: list[str], late: str = "24 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by window and key; state older than the watermark is dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a table of the shared folder, and reads that."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", f"{at}/out-rows").outputMode("append")
    else:
        # the last batch holds every key's latest row
        writer = df.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/out-rows")).outputMode(mode)
    writer.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out-rows")
