"""Upkeep of a kept neighbour graph: changes touch the lists that they can reach, the others stay.

The graph is (src, dst, weight): each node's ``k`` best by cosine of ``least`` or more.
Of a delta, ``gone`` are removed ids, ``fresh`` vectors that are new or changed.

Lists may be kept deeper than ``k`` (``deep``), so that those that lose entries have others behind them.
A list that was cut is ``open``: what comes after its last entry is not known. One that is not holds all of ``least`` or more.

* Open lists with fewer than ``k`` entries left are made anew; so are those of fresh nodes.
* Every other list is merged with its similarities to the fresh vectors, which are few; an open
  one takes those that come before its last entry.

Both are exact searches of a bounded side against the table, not of the table against itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.dense import knn
from quillon.sources.shared import materialise


def full(vectors: DataFrame, k: int = 10, least: float = 0.1) -> DataFrame:
    """The graph of (id, v)."""
    return full_of(vectors, vectors, k, least)


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("score").alias("weight"))


def _cut(deep: int) -> Column:
    """Whether a list may go on behind its last entry."""
    return F.count("*").over(Window.partitionBy("src")) >= deep


def lists(vectors: DataFrame, deep: int = 20, least: float = 0.1) -> DataFrame:
    """(src, dst, weight, open): the lists of (id, v), ``deep`` entries at most."""
    return materialise(full(vectors, deep, least).withColumn("open", _cut(deep)), "lists")


def best(kept: DataFrame, k: int) -> DataFrame:
    """The graph: the first ``k`` entries of each list."""
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return kept.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("src", "dst", "weight")


def renewed(kept: DataFrame, vectors: DataFrame, fresh: DataFrame, gone: DataFrame, k: int = 10, deep: int = 20, least: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The lists and the vectors after a delta: fresh (id, v), gone (id)."""
    changed = materialise(fresh.select("id").unionByName(gone.select("id")).distinct(), "changed")
    now = materialise(vectors.join(changed, "id", "left_anti").unionByName(fresh.select("id", "v")), "vectors")
    left = kept.join(changed, F.col("src") == F.col("id"), "left_anti")
    left = left.join(changed.select(F.col("id").alias("dst"), F.lit(True).alias("_lost")), "dst", "left")
    place = F.struct((-F.col("weight")).alias("w"), F.col("dst").alias("d"))
    last = F.max(F.when(F.col("_lost").isNull(), place))
    state = materialise(left.groupBy("src").agg(F.first("open").alias("open"), F.count_if(F.col("_lost").isNull()).alias("_n"), last.alias("_last")), "states")
    again = materialise(state.filter(F.col("open") & (F.col("_n") < k)).select(F.col("src").alias("id")).unionByName(fresh.select("id")).distinct(), "made-anew")
    made = full_of(now, now.join(again, "id", "left_semi"), deep, least).withColumn("open", _cut(deep))
    stay = left.filter("_lost is null").select("src", "dst", "weight", "open").join(again, F.col("src") == F.col("id"), "left_anti")
    if not fresh.isEmpty():
        gained = full_of(fresh.select("id", "v"), now.join(again, "id", "left_anti"), deep, least)
        known = gained.join(state.select("src", "open", "_last"), "src", "left").filter(~F.coalesce("open", F.lit(False)) | (place < F.col("_last")))
        both = stay.unionByName(known.select("src", "dst", "weight", F.coalesce("open", F.lit(False)).alias("open")))
        order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
        both = both.withColumns({"_r": F.row_number().over(order), "open": F.max("open").over(Window.partitionBy("src")) | _cut(deep)})
        stay = both.filter(F.col("_r") <= deep).drop("_r")
    return materialise(stay.unionByName(made), "lists"), now


def full_of(vectors: DataFrame, asked: DataFrame, k: int, least: float) -> DataFrame:
    """Lists of the (id, v) of ``asked`` over those of ``vectors``."""
    return _edges(knn(vectors, asked.withColumnRenamed("id", "query_id"), k, least=least))


def refreshed(graph: DataFrame, vectors: DataFrame, fresh: DataFrame, gone: DataFrame, k: int = 10, least: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """``renewed`` for a graph that is kept without further entries."""
    kept, now = renewed(graph.withColumn("open", _cut(k)), vectors, fresh, gone, k, k, least)
    return kept.drop("open"), now
