"""Telemetry and ranking quality over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_percentiles(events: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Floor percentiles without gathering: equal values are counted first, then ranked by running sums."""
    counted = events.groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy(value)
    ranked = counted.withColumns({"_to": F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    at = lambda p: F.floor(F.col("_n") * p)
    hit = lambda p: F.max(F.when((at(p) < F.col("_to")) & (at(p) >= F.col("_to") - F.col("_c")), F.col(value)))
    return ranked.groupBy(*by).agg(F.max("_n").alias("n"), *[hit(p).alias(name) for name, p in shares.items()])


def prefix_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10, wanted: DataFrame | None = None) -> DataFrame:
    """Precision, recall and gain at every rank up to k, for (query_id, id, score, rank) and the relevant (query_id, id).

    As the service defines them: an irrelevant document gains its score, and the
    ideal list is all hits; ``ndcg_textbook`` is the usual measure. ``wanted``
    (query_id, wanted) tells how many are relevant where ``truth`` has ranked ones only.
    """
    marked = ranked.filter(F.col("rank") <= k).join(truth.select("query_id", "id").distinct().withColumn("rel", F.lit(1)), ["query_id", "id"], "left").na.fill(0, ["rel"])
    wanted = wanted if wanted is not None else truth.groupBy("query_id").agg(F.count_distinct("id").alias("wanted"))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    discount = 1 / F.log2(F.col("rank") + 1)
    out = marked.join(wanted, "query_id", "left").na.fill(0, ["wanted"]).withColumns(
        {
            "hits": F.sum("rel").over(upto), "dcg": F.sum(F.when(F.col("rel") == 1, 1.0).otherwise(F.col("score")) * discount).over(upto),
            "ideal": F.sum(discount).over(upto), "dcg_binary": F.sum(F.col("rel") * discount).over(upto),
            "ideal_binary": F.sum(F.when(F.col("rank") <= F.col("wanted"), discount).otherwise(0.0)).over(upto),
        }
    )
    return out.select(
        "query_id", "rank", (F.col("hits") / F.col("rank")).alias("precision"), F.coalesce(F.try_divide("hits", "wanted"), F.lit(0.0)).alias("recall"),
        (F.col("dcg") / F.col("ideal")).alias("ndcg"), F.coalesce(F.try_divide("dcg_binary", "ideal_binary"), F.lit(0.0)).alias("ndcg_textbook"),
    )


def mean_average(metrics: DataFrame) -> DataFrame:
    """(query_id, map_reference): the sum of precision times recall by the number of ranks."""
    return metrics.groupBy("query_id").agg((F.sum(F.col("precision") * F.col("recall")) / F.count("*")).alias("map_reference"))


def halving_average(events: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(*by, average): the recurrence (average + x) / 2 from 0, in the given order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_x"))))
    return events.groupBy(*by).agg(F.aggregate(items, F.lit(0.0), lambda q, s: (q + s["_x"]) / 2).alias("average"))


def transitions(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Rows at which a key's status changes, with the one before and the kind of change."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    changed = events.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col(status)))
    kind = F.when(F.col(status) == "error", "degraded").when(F.col("before") == "error", "recovered").otherwise("changed")
    return changed.withColumn("kind", kind)


def sampled(events: DataFrame, rate: float, key: str = "event_id") -> DataFrame:
    """A share of the events, the same ones on every run."""
    return events.filter(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(10_000)) < int(rate * 10_000))
