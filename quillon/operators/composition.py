"""Rules over sets of design patterns: conflicts, synergies, what is missing, what must come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pairs that conflict (with severity), go together, repeat each other, what must come before,
# costs, misuses by a word of the description, and what to do.
CONFLICTS = {("Singleton", "Prototype"): "high"}
CLASHES = [("Singleton", "Prototype"), ("Flyweight", "Singleton")]
SYNERGIES = [("Factory Method", "Abstract Factory"), ("Observer", "Mediator"), ("Adapter", "Decorator")]
REDUNDANT = [("Factory Method", "Abstract Factory"), ("Adapter", "Decorator")]
BEFORE = {"Abstract Factory": ["Factory Method"], "Decorator": ["Component"], "Composite": ["Component"]}
COSTS = {"high": 20, "medium": 10, "low": 5}
MISUSES = {"Singleton": ("testing", "Singleton in Tests", "medium", "Use dependency injection instead"), "Observer": ("performance", "Observer Performance Issue", "low", "Consider event batching or filtering")}
FIXES = {"overload": "Reduce to 3-5 essential patterns", "conflict": "Choose one or refactor to avoid conflict", "redundancy": "Consider removing or consolidating"}


def has_all(names: Column, wanted) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), names)) == 0


def largest_share(categories: Column) -> Column:
    """The most frequent category's part of an array."""
    most = F.array_max(F.transform(F.array_distinct(categories), lambda c: F.size(F.filter(categories, lambda x: x == c))))
    return F.try_divide(most, F.size(categories))


def analysed(sets: DataFrame) -> DataFrame:
    """Adds violations, synergies, clashes, redundant, score, valid and warnings to (id, names, categories)."""
    names = F.col("names")
    count = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    cost = sum((has_all(names, p).cast("int") * COSTS[s] for p, s in CONFLICTS.items()), F.lit(0))
    synergies = count(has_all(names, p) for p in SYNERGIES)
    share = F.coalesce(largest_share(F.col("categories")), F.lit(1.0))
    score = 100 - cost + synergies * 10 + (1 - share) * 10
    violations = count(has_all(names, p) for p in CONFLICTS)
    warn = F.array_compact(F.array(F.when(F.size(names) > 5, "complexity"), F.when(share > 0.6, "balance")))
    return sets.withColumns(
        {
            "violations": violations, "synergies": synergies, "clashes": count(has_all(names, p) for p in CLASHES),
            "redundant": F.array_compact(F.array(*[F.when(has_all(names, p), p[1]) for p in REDUNDANT])), "overload": F.size(names) > 8,
            "score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score.cast("double"))), "valid": violations == 0, "warnings": warn,
        }
    )


def anti_patterns(sets: DataFrame) -> DataFrame:
    """(id, anti_pattern, severity, location, fix) of (id, names, descriptions): too many patterns, pairs that conflict or repeat each other, and misuses, one for each time a pattern is named."""
    names = F.col("names")
    fault = lambda name, severity, place, fix: F.struct(F.lit(name).alias("anti_pattern"), F.lit(severity).alias("severity"), F.lit(place).alias("location"), F.lit(fix).alias("fix"))
    of_set = [F.when(F.size(names) > 8, fault("Pattern Overload", "high", "Architecture", FIXES["overload"]))]
    of_set += [F.when(has_all(names, p), fault("Pattern Conflict", "medium", " + ".join(p), FIXES["conflict"])) for p in CLASHES]
    of_set += [F.when(has_all(names, p), fault("Pattern Redundancy", "low", p[1], FIXES["redundancy"])) for p in REDUNDANT]

    def misuse(name, description):
        out = F.lit(None)
        for n, (word, what, severity, fix) in MISUSES.items():
            out = F.when((name == n) & F.contains(description, F.lit(word)), fault(what, severity, n, fix)).otherwise(out)
        return out

    found = F.concat(F.array_compact(F.array(*of_set)), F.array_compact(F.zip_with("names", "descriptions", misuse)))
    return sets.select("id", F.explode(found).alias("f")).select("id", "f.*")


def order_faults(sequences: DataFrame) -> DataFrame:
    """(id, name, missing): names whose forerunner does not stand before them in (id, names)."""
    rows = sequences.select("id", "names", F.posexplode("names").alias("at", "name"))
    table = F.create_map(*[c for k, v in BEFORE.items() for c in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    wanted = rows.withColumn("missing", F.explode(F.try_element_at(table, F.col("name"))))
    place = F.array_position("names", F.col("missing"))
    return wanted.filter((place == 0) | (place > F.col("at"))).select("id", "name", "missing")


# What goes with a pattern, combinations for a problem or a context, and the order in which patterns are laid.
COMPLEMENTS = {
    "Factory Method": ["Abstract Factory", "Prototype"], "Observer": ["Mediator", "Command"], "Adapter": ["Decorator", "Facade"],
    "Strategy": ["State", "Template Method"], "Builder": ["Prototype", "Flyweight"],
}
FOR_PROBLEM = {
    "object creation": [(["Factory Method", "Abstract Factory"], 0.9), (["Builder", "Prototype"], 0.8)],
    "structural organization": [(["Adapter", "Facade"], 0.85), (["Decorator", "Composite"], 0.8)],
    "behavior coordination": [(["Observer", "Command"], 0.9), (["Strategy", "State"], 0.85)],
}
FOR_CONTEXT = {"performance": (["Flyweight", "Object Pool"], 0.8), "scalability": (["Proxy", "Observer"], 0.75)}
ORDER = [
    "Singleton", "Factory Method", "Abstract Factory", "Builder", "Prototype", "Adapter", "Bridge", "Composite", "Decorator", "Facade", "Flyweight", "Proxy",
    "Chain of Responsibility", "Command", "Iterator", "Mediator", "Memento", "Observer", "State", "Strategy", "Template Method", "Visitor",
]


def ordered(names: Column) -> Column:
    """Distinct names in the canonical order, the others behind as they came."""
    canon = F.array(*[F.lit(n) for n in ORDER])
    once = F.array_distinct(names)
    return F.concat(F.filter(canon, lambda n: F.array_contains(once, n)), F.array_except(once, canon))


def complementary(sets: DataFrame) -> DataFrame:
    """(id, name, missing): what goes with a name and is not in the set."""
    table = F.create_map(*[c for k, v in COMPLEMENTS.items() for c in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    rows = sets.select("id", "names", F.explode(F.array_distinct("names")).alias("name"))
    return rows.withColumn("missing", F.explode(F.try_element_at(table, F.col("name")))).filter(~F.array_contains("names", F.col("missing"))).select("id", "name", "missing")


def combinations(asked: DataFrame) -> DataFrame:
    """(problem, context, names, confidence): combinations that a problem's or context's words call for."""
    says = lambda when, names, c: F.when(when, F.struct(F.lit(" + ".join(names)).alias("names"), F.lit(c).alias("confidence")))
    parts = [says(F.contains(F.lower("problem"), F.lit(k)), n, c) for k, v in FOR_PROBLEM.items() for n, c in v]
    parts += [says(F.contains(F.col("context"), F.lit(k)), n, c) for k, (n, c) in FOR_CONTEXT.items()]
    return asked.select("problem", "context", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("problem", "context", "x.*")
