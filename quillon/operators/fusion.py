"""Fusion of result lists: weighted blend, reciprocal ranks, diversity."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import key_points

#: Weights of the legs and the rank's offset.
RRF_WEIGHTS = {"dense": 0.6, "sparse": 0.4, "graph": 0.2}
RRF_K = 60


def blend(semantic: DataFrame, keyword: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, id, semantic, keyword, confidence) of two legs (query_id, id, score).

    ``weights``: query_id, semantic_alpha, keyword_alpha. Keyword scores stop at
    0.99; where both legs have a score they are weighted, else the one counts.
    """
    s = semantic.select("query_id", "id", F.col("score").alias("semantic"))
    k = keyword.select("query_id", "id", F.least("score", F.lit(0.99)).alias("keyword"))
    both = s.join(k, ["query_id", "id"], "full").na.fill(0.0, ["semantic", "keyword"]).join(weights.select("query_id", "semantic_alpha", "keyword_alpha"), "query_id")
    ws, wk = F.col("semantic_alpha"), F.col("keyword_alpha")
    mixed = (ws * F.col("semantic") + wk * F.col("keyword")) / (ws + wk)
    confidence = F.when((F.col("semantic") > 0) & (F.col("keyword") > 0), mixed).when(F.col("semantic") > 0, F.col("semantic")).otherwise(F.col("keyword"))
    return both.select("query_id", "id", "semantic", "keyword", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"))


def reciprocal_ranks(legs: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, legs) of lists (query_id, id, rank): weight / (k + rank) summed, by 1.1 with several legs, 1 at most."""
    weights = weights or RRF_WEIGHTS
    parts = [df.select("query_id", "id", (F.lit(weights[name]) / (k + F.col("rank"))).alias("part")) for name, df in legs.items()]
    summed = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("part").alias("part"), F.count("*").alias("legs"))
    boosted = F.when(F.col("legs") > 1, F.col("part") * 1.1).otherwise(F.col("part"))
    return summed.select("query_id", "id", F.least(boosted, F.lit(1.0)).alias("score"), "legs")


def mmr(candidates: DataFrame, keep: int = 10, balance: float = 0.7) -> DataFrame:
    """(query_id, id, place, gain): greedy choice by balance * score + (1 - balance) * (1 - greatest similarity to those chosen).

    ``candidates``: query_id, id, score, v; a query's candidates must fit in
    memory (they are a top-k list).
    """

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        x = np.array(group["v"].tolist(), float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near, left, out = np.zeros(len(group)), list(range(len(group))), []
        while left and len(out) < keep:
            gain = [round(balance * group["score"][i] + (1 - balance) * (1 - near[i]), 9) for i in left]
            at = int(np.argmax(gain))
            i = left.pop(at)
            out.append((int(group["query_id"][i]), int(group["id"][i]), len(out) + 1, gain[at]))
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame(out, columns=["query_id", "id", "place", "gain"])

    return candidates.groupBy("query_id").applyInPandas(chosen, "query_id long, id long, place int, gain double")


def diverse(results: DataFrame, most: int) -> DataFrame:
    """Keeps ``most`` rows of each query: the first of every category and those over 0.8 first, then the best of the rest.

    ``results``: query_id, id, category, score.
    """
    order = lambda *by: Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "id")
    first = (F.row_number().over(order(F.lower("category"))) == 1) | (F.col("score") > 0.8)
    marked = results.withColumn("_first", first)
    return marked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_first"), F.desc("score"), "id"))).filter(F.col("place") <= most).drop("_first")


def reranked(results: DataFrame, query: str = "query", name: str = "name", category: str = "category", tags: str = "tags") -> DataFrame:
    """Raises ``score`` by 1.2 for the query in the name, 1.1 for each word in the category, 1.05 for each word in each tag; 1 at most."""
    words = F.split(F.lower(query), r"\s+", -1)
    in_category = F.size(F.filter(words, lambda w: F.contains(F.lower(category), w)))
    in_tags = F.aggregate(F.transform(tags, lambda t: F.size(F.filter(words, lambda w: F.contains(F.lower(t), w)))), F.lit(0), lambda a, x: a + x)
    boost = F.when(F.contains(F.lower(name), F.lower(query)), 1.2).otherwise(1.0) * F.pow(F.lit(1.1), in_category) * F.pow(F.lit(1.05), in_tags)
    return results.withColumn("score", F.least(F.col("score") * boost, F.lit(1.0)))


def compressed(results: DataFrame, tokens: int, keep: int = 5) -> DataFrame:
    """Fits each query's results (query_id, id, category, score, text) in 0.8 of a budget of tokens (4 characters each).

    Up to three pass as they are; else the best and up to ``keep`` diverse ones are
    taken until 50 tokens or fewer are left. Adds ``used`` tokens and ``place``.
    """
    budget = int(tokens * 0.8)
    n = F.count("*").over(Window.partitionBy("query_id"))
    sized = results.withColumns({"_n": n, "cost": F.ceil(F.length("text") / 4)})
    few = sized.filter("_n <= 3").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    many = diverse(sized.filter("_n > 3"), keep + 1)
    spent = F.sum("cost").over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    many = many.withColumn("_spent", F.coalesce(spent, F.lit(0))).filter((F.col("place") == 1) | (F.col("_spent") < budget - 50))
    used = F.when(F.col("_n") <= 3, F.col("cost")).otherwise(F.greatest(F.least("cost", budget - F.col("_spent")), F.lit(0)))
    return few.withColumn("_spent", F.lit(0).cast("long")).unionByName(many).withColumn("used", used).select("query_id", "id", "place", F.col("used").cast("long").alias("used"))


def compressed_texts(results: DataFrame, tokens: int, keep: int = 5) -> DataFrame:
    """(query_id, id, place, used, text): as ``compressed``, with each text cut to whole sentences that fit what its result may use.

    The best sentences of a text come first (``functions.text.key_points``), as long as they fit
    in four characters a token. Results that pass as they are keep their texts.
    """
    taken = compressed(results, tokens, keep)
    joined = taken.join(results.select("query_id", "id", F.col("text").alias("_text")), ["query_id", "id"])
    whole = F.ceil(F.length("_text") / 4) <= F.col("used")
    text = F.when(whole, F.col("_text")).otherwise(key_points(F.col("_text"), F.col("used") * 4))
    return joined.select("query_id", "id", "place", "used", text.alias("text"))
