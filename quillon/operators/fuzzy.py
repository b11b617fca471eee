"""Fuzzy relevance: memberships, rules, and the way back to one number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds and texts of the rules, in their order (rule 5 does not exist).
RULES = {
    1: (0.35, "very_high", "High semantic similarity AND strong keyword match → Very High Relevance"),
    2: (0.40, "very_high", "High semantic similarity AND excellent contextual fit → Very High Relevance"),
    3: (0.2, "high", "Medium semantic similarity AND moderate keyword match AND good contextual fit → High Relevance"),
    4: (0.2, "high", "Medium semantic similarity AND strong keyword match → High Relevance"),
    6: (0.7, "low", "Poor contextual fit → Low Relevance"),
    7: (0.3, "high", "Complex pattern with high semantic similarity → High Relevance"),
    8: (0.4, "medium", "Simple pattern with high semantic similarity → Medium Relevance"),
}
SETS = ("low", "medium", "high", "very_high")
PRELIMINARY, CENTRES, PEAKS = (0.1, 0.4, 0.7, 0.9), (0.15, 0.45, 0.80, 0.95), (0.2, 0.5, 0.75, 0.85)


def _ladder(x: Column, steps: list[tuple[float, Column]], last: Column) -> Column:
    out = F.when(x <= steps[0][0], steps[0][1])
    for upto, value in steps[1:]:
        out = out.when(x <= upto, value)
    return out.otherwise(last)


def membership(df: DataFrame, semantic: str = "semantic", keyword: str = "keyword", complexity: str = "complexity", fit: str = "fit") -> DataFrame:
    """Adds the memberships as columns sem_*, key_*, cpx_* and fit_*."""
    s, k, f, one, none = F.col(semantic), F.col(keyword), F.col(fit), F.lit(1.0), F.lit(0.0)
    c = F.lower(complexity)
    level = lambda words: c.isin(words.split())
    known = [level("low simple"), level("medium intermediate"), level("high complex advanced")]
    by_level = lambda on, other: F.when(known[0], on[0]).when(known[1], on[1]).when(known[2], on[2]).otherwise(other)
    return df.withColumns(
        {
            "sem_low": _ladder(s, [(0.25, one), (0.45, (0.45 - s) / 0.2)], none),
            "sem_medium": _ladder(s, [(0.25, none), (0.45, (s - 0.25) / 0.2), (0.65, (0.65 - s) / 0.2)], none),
            "sem_high": _ladder(s, [(0.45, none), (0.65, (s - 0.45) / 0.2)], one),
            "key_weak": _ladder(k, [(0.1, one), (0.25, (0.25 - k) / 0.15)], none),
            "key_moderate": _ladder(k, [(0.1, none), (0.25, (k - 0.1) / 0.15), (0.45, (0.45 - k) / 0.2), (0.65, (0.65 - k) / 0.2)], none),
            "key_strong": _ladder(k, [(0.25, none), (0.45, (k - 0.25) / 0.2), (0.65, (k - 0.45) / 0.2)], one),
            "cpx_simple": by_level((1.0, 0.0, 0.0), 0.2), "cpx_moderate": by_level((0.0, 1.0, 0.0), 0.8), "cpx_complex": by_level((0.0, 0.0, 1.0), 0.2),
            "fit_poor": _ladder(f, [(0.15, one), (0.40, (0.40 - f) / 0.25)], none),
            "fit_good": _ladder(f, [(0.15, none), (0.40, (f - 0.15) / 0.25), (0.65, one), (1.0, (1.0 - f) / 0.35)], none),
            "fit_excellent": _ladder(f, [(0.65, none), (1.0, (f - 0.65) / 0.35)], one),
        }
    )


def dominant(prefix: str, names: list[str]) -> Column:
    """The name of the greatest membership; the first wins ties."""
    ranked = F.array(*[F.struct(F.col(f"{prefix}_{n}").alias("m"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)])
    return F.array_max(ranked)["n"]


def inferred(df: DataFrame) -> DataFrame:
    """Adds the output sets out_low .. out_very_high, ``firings`` (rule, strength) and ``preliminary`` to memberships."""
    strength = {
        1: F.least("sem_high", "key_strong"), 2: F.least("sem_high", "fit_excellent"), 3: F.least("sem_medium", "key_moderate", "fit_good"),
        4: F.least("sem_medium", "key_strong"), 6: F.col("fit_poor"), 7: F.least("cpx_complex", "sem_high"), 8: F.least("cpx_simple", "sem_high"),
    }
    fires = {r: strength[r] > RULES[r][0] for r in RULES}
    of = {s: [F.when(fires[r], strength[r]).otherwise(0.0) for r in RULES if RULES[r][1] == s] for s in SETS}
    out = df.withColumns({f"_{s}": F.greatest(*of[s], F.lit(0.0)) for s in SETS} | {
        "_fired": F.array_compact(F.array(*[F.when(fires[r], F.struct(F.lit(RULES[r][2]).alias("rule"), strength[r].alias("strength"))) for r in RULES])),
        "_default": F.greatest(F.least(
            F.col("sem_high") * 0.6 + F.col("sem_medium") * 0.3 + F.col("key_strong") * 0.5 + F.col("key_moderate") * 0.2 + F.col("fit_excellent") * 0.4 + F.col("fit_good") * 0.2, F.lit(0.7)), F.lit(0.1)),
    })
    weak, d = F.greatest(*[F.col(f"_{s}") for s in SETS]) < 0.5, F.col("_default")
    raised = lambda s, when, value: F.when(weak & when, F.greatest(F.col(f"_{s}"), value)).otherwise(F.col(f"_{s}"))
    text = F.when(d > 0.55, "Smart default: High relevance based on combined evidence").when(d > 0.35, "Smart default: Medium relevance based on available evidence").when(
        d > 0.2, "Smart default: Low relevance - limited matching evidence").otherwise("Smart default: Very low relevance - minimal matching evidence")
    low_value = F.when(d > 0.2, d).otherwise(0.15)
    default = F.struct(text.alias("rule"), F.when(d > 0.2, d).otherwise(0.15).alias("strength"))
    out = out.withColumns(
        {
            "out_low": raised("low", d <= 0.35, low_value), "out_medium": raised("medium", (d > 0.35) & (d <= 0.55), d), "out_high": raised("high", d > 0.55, d),
            "out_very_high": F.col("_very_high"), "firings": F.when(weak, F.array_append("_fired", default)).otherwise(F.col("_fired")),
        }
    ).drop(*[f"_{s}" for s in SETS], "_fired", "_default")
    whole = sum((F.col(f"out_{s}") for s in SETS), F.lit(0.0))
    weighted = sum((F.col(f"out_{s}") * w for s, w in zip(SETS, PRELIMINARY, strict=True)), F.lit(0.0)) / F.nullif(whole, F.lit(0.0))
    return out.withColumn("preliminary", F.when(whole < 0.3, F.greatest(F.lit(0.1), weighted)).otherwise(F.coalesce(weighted, F.lit(0.5))))


def defuzzified(df: DataFrame) -> DataFrame:
    """Adds ``relevance`` (centre of the output sets), ``certainty``, ``peak`` and ``explanation``."""
    outs = [F.col(f"out_{s}") for s in SETS]
    whole = sum(outs, F.lit(0.0))
    centre = sum((o * c for o, c in zip(outs, CENTRES, strict=True)), F.lit(0.0)) / F.nullif(whole, F.lit(0.0))
    ranked = F.array(*[F.struct(o.alias("m"), F.lit(-i).alias("i"), F.lit(p).alias("p")) for i, (o, p) in enumerate(zip(outs, PEAKS, strict=True))])
    out = df.withColumns(
        {
            "relevance": F.coalesce(centre, F.lit(0.5)), "certainty": F.when(whole == 0, 0.0).otherwise(F.least(F.greatest(*outs) * 0.9 + 0.1, F.lit(0.95))),
            "peak": F.when(whole == 0, 0.5).otherwise(F.array_max(ranked)["p"]),
        }
    )
    level = F.when(F.col("relevance") < 0.3, "low").when(F.col("relevance") < 0.7, "medium").otherwise("high")
    sure = F.when(F.col("certainty") > 0.8, "high").when(F.col("certainty") > 0.6, "medium").otherwise("low")
    return out.withColumn("explanation", F.format_string("relevance: %s (%.1f%%). Confidence: %s (%.1f%%).", level, F.col("relevance") * 100, sure, F.col("certainty") * 100))


def decomposed(semantic: Column, keyword: Column, blended: Column, alpha: float = 0.7) -> tuple[Column, Column]:
    """The semantic and keyword parts of a blended score, from the legs where they are known."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    both, only_k, only_s = semantic.isNotNull() & keyword.isNotNull() & (semantic + keyword > 0), keyword > 0, semantic > 0
    s = F.when(both, unit(semantic)).when(only_k, 0.0).when(only_s, unit(semantic)).otherwise(unit(blended * alpha))
    k = F.when(both, unit(keyword)).when(only_k, unit(keyword)).when(only_s, 0.0).otherwise(unit(blended * (1 - alpha)))
    return s, k


def contextual_fit(query: Column, language: Column, tags: Column, category: Column, complexity: Column) -> Column:
    low = F.lower(query)
    start = F.lower(F.substring(language, 1, 3))
    tagged = F.exists(tags, lambda t: F.contains(F.lower(t), start))
    fit = F.lit(0.5) + F.when(language.isNull(), 0.0).when(tagged, 0.3).otherwise(-0.1)
    fit = fit + F.when((F.contains(low, F.lit("create")) | F.contains(low, F.lit("factory"))) & (F.lower(category) == "creational"), 0.2).otherwise(0.0)
    fit = fit + F.when((F.size(F.split(query, " ", -1)) <= 3) & (F.lower(complexity) == "low"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), fit))
