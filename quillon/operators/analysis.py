"""Query analysis: weights of the semantic and the keyword leg, and the strategy that a query calls for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T


def _hits(text: Column, words: list[str], each: float) -> Column:
    found = reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])
    return F.least(found * F.lit(each), F.lit(0.5))


def dynamic_alpha(queries: DataFrame) -> DataFrame:
    """Adds semantic_alpha, keyword_alpha, query_type and confidence to (..., text)."""
    low, words = F.lower("text"), T.blank_words(F.lower("text"))
    out = queries.withColumns(
        {
            "_n": F.size(words), "_len": F.length("text"), "_tech": F.size(F.filter(words, lambda w: T.contains_any(w, T.TECHNICAL))),
            "_expl": _hits(low, T.EXPLORATORY, 0.15), "_spec": _hits(low, T.SPECIFIC, 0.12),
            "_code": F.col("text").rlike(r"`[^`]+`|\{[^{]+\}|\([^(]+\)"), "_entropy": T.unique_ratio(F.col("text")),
        }
    )
    branch = (
        F.when((F.col("_n") <= 2) & (F.col("_spec") >= 0.1), 1).when((F.col("_n") > 5) & (F.col("_expl") > 0.2), 2)
        .when((F.col("_tech") > 0) & (F.col("_n") > 3), 3).when(F.col("_code"), 4).when((F.col("_entropy") > 0.6) & (F.col("_n") > 3), 5).otherwise(6)
    )
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_b"))
    out = out.withColumn("_b", branch)
    shift = F.when(F.col("_len") > 100, 0.1).when(F.col("_len") < 30, -0.15).otherwise(0.0)
    out = out.withColumns({"_s": pick(0.3, 0.7, 0.6, 0.4, 0.65, 0.5) + shift, "_k": pick(0.7, 0.3, 0.4, 0.6, 0.35, 0.5) - shift})
    within = lambda x: F.greatest(F.lit(0.1), F.least(F.lit(0.9), x))
    return out.withColumns(
        {
            "semantic_alpha": within(F.col("_s") / (F.col("_s") + F.col("_k"))), "keyword_alpha": within(F.col("_k") / (F.col("_s") + F.col("_k"))),
            "query_type": pick("specific", "exploratory", "exploratory", "specific", "exploratory", "balanced"),
            "confidence": F.least(F.lit(0.9), pick(0.7, 0.75, 0.65, 0.6, 0.55, 0.5) + F.col("_tech") * 0.05),
        }
    ).drop("_n", "_len", "_tech", "_expl", "_spec", "_code", "_entropy", "_b", "_s", "_k")


def strategy(queries: DataFrame) -> DataFrame:
    """Adds query_type, strategy and confidence to (..., text), as the fused engine classes queries."""
    words = T.blank_words(F.col("text"))
    terms = F.size(F.filter(words, lambda w: T.contains_any(F.lower(w), T.ENGINE_TERMS)))
    n, entropy = F.size(words), F.size(F.array_distinct(F.split(F.lower("text"), ""))) / F.greatest(F.length("text"), F.lit(1))
    code = F.col("text").rlike(r"`[^`]+`|\{[^{]+\}")
    out = queries.withColumns({"_n": n, "_t": terms, "_e": entropy, "_c": code})
    out = out.withColumn("_b", F.when((F.col("_n") <= 3) & (F.col("_t") > 0), 1).when((F.col("_n") > 5) & (F.col("_e") < 0.6), 2).when(F.col("_c"), 3).when((F.col("_e") > 0.65) & (F.col("_n") > 3), 4).otherwise(5))
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_b"))
    out = out.withColumns({"query_type": pick("specific", "exploratory", "specific", "exploratory", "balanced"), "_s": pick("sparse", "dense", "hybrid", "dense", "hybrid"), "_f": pick(0.8, 0.75, 0.7, 0.6, 0.5)})
    dense = F.col("_t") > 2
    return out.withColumns(
        {"strategy": F.when(dense & (F.col("_s") != "dense"), "hybrid").otherwise(F.col("_s")), "confidence": F.least(F.lit(1.0), F.col("_f") + F.when(dense, 0.1).otherwise(0.0))}
    ).drop("_n", "_t", "_e", "_c", "_b", "_s", "_f")
