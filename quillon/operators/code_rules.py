"""Rules over source text: design patterns, anti-patterns, improvements, duplicate blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What tells a design pattern in code (keywords, then expressions in their order), what tells a method, families, and reasons for suggestions.
INDICATORS: dict[str, tuple[list[str], list[str]]] = {
    "Singleton": (
        ["getInstance", "instance", "private constructor", "_instance", "singleton"],
        [r"private\s+static\s+\w+\s+instance", r"getInstance\s*\(\s*\)", r"private\s+constructor\s*\(", r"_instance\s*=\s*null"],
    ),
    "Factory Method": (
        ["createProduct", "create", "factory", "makeProduct"],
        [r"create\w+\s*\([^)]*\)\s*:\s*\w+", r"factory\s*\([^)]*\)\s*\{", r"abstract\s+\w+\s+create", r"make\w+\s*\([^)]*\)"],
    ),
    "Abstract Factory": (["createProductA", "createProductB", "AbstractFactory"], [r"abstract\s+class\s+\w*Factory", r"createProduct[AB]\s*\(", r"interface\s+\w*Factory"]),
    "Builder": (["build", "Builder", "withField", "addPart"], [r"class\s+\w+Builder", r"\.build\s*\(\s*\)", r"with\w+\s*\([^)]*\)\s*:\s*this", r"return\s+this"]),
    "Prototype": (["clone", "copy", "duplicate", "prototype"], [r"clone\s*\(\s*\)\s*:", r"Object\.create\(", r"\.prototype\.", r"copy\s*\(\s*\)\s*:"]),
    "Adapter": (["adapt", "Adapter", "wrapper", "convert"], [r"class\s+\w+Adapter", r"implements\s+\w+Interface", r"this\.\w+\s*=\s*new\s+\w+"]),
    "Decorator": (["Decorator", "wrapper", "enhance", "decorate"], [r"class\s+\w+Decorator", r"extends\s+\w+Decorator", r"super\.\w+\(", r"@\w+"]),
    "Proxy": (["Proxy", "surrogate", "placeholder"], [r"class\s+\w+Proxy", r"new\s+Proxy\(", r"realSubject", r"this\.\w+\.\w+\("]),
    "Facade": (["Facade", "simplify", "interface"], [r"class\s+\w+Facade", r"this\.\w+\s*=\s*new", r"simplify\w+\("]),
    "Observer": (
        ["subscribe", "notify", "observer", "listener", "addEventListener"],
        [r"subscribe\s*\([^)]*\)", r"notify\w*\s*\([^)]*\)", r"addEventListener\s*\(", r"on\w+\s*\([^)]*\)", r"emit\s*\([^)]*\)"],
    ),
    "Strategy": (["Strategy", "algorithm", "setStrategy", "execute"], [r"class\s+\w+Strategy", r"setStrategy\s*\(", r"execute\w*\s*\(", r"interface\s+Strategy"]),
    "Command": (["Command", "execute", "undo", "redo"], [r"class\s+\w+Command", r"execute\s*\(\s*\)", r"undo\s*\(\s*\)", r"interface\s+Command"]),
    "Iterator": (["Iterator", "next", "hasNext", "current"], [r"class\s+\w+Iterator", r"hasNext\s*\(\s*\)", r"next\s*\(\s*\)", r"\[Symbol\.iterator\]"]),
    "Template Method": (["template", "abstract", "hook", "algorithm"], [r"abstract\s+\w+\s*\(", r"protected\s+abstract", r"final\s+\w+\s*\("]),
}
METHODS = r"function\s+\w+|[\w]+\s*\([^)]*\)\s*\{"
CATEGORIES = {
    "Creational": ["Singleton", "Factory Method", "Abstract Factory", "Builder", "Prototype"],
    "Structural": ["Adapter", "Bridge", "Composite", "Decorator", "Facade", "Flyweight", "Proxy"],
    "Behavioral": ["Chain of Responsibility", "Command", "Iterator", "Mediator", "Memento", "Observer", "State", "Strategy", "Template Method", "Visitor"],
}
REASONS = {
    "Singleton": ("Consider Singleton pattern for managing global state", 0.6),
    "Factory Method": ("Multiple object instantiations detected - consider Factory pattern", 0.7),
    "Observer": ("Event handling code detected - Observer pattern could improve decoupling", 0.6),
    "Strategy": ("Complex conditional logic detected - Strategy pattern could simplify", 0.5),
    "Builder": ("Complex constructor detected - Builder pattern could improve readability", 0.7),
}


def category(name: Column) -> Column:
    """The family of a design pattern, else Unknown."""
    out = F.lit("Unknown")
    for family, members in CATEGORIES.items():
        out = F.when(name.isin(*members), family).otherwise(out)
    return out


def detected(code: DataFrame, only=tuple(INDICATORS)) -> DataFrame:
    """Adds ``found`` to (id, code), an array of (pattern, step, confidence): an entry for every expression that matches once the confidence, 0.2 a keyword and 0.3 an expression so far, is over 0.4.

    Keywords and expressions are tried once a text, before their counts are combined.
    """
    count = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    tried = {n: F.struct(count(F.contains("_low", F.lit(k.lower())) for k in INDICATORS[n][0]).alias("keywords"), F.array(*[F.col("code").rlike(f"(?i){p}") for p in INDICATORS[n][1]]).alias("hits")) for n in only}
    out = code.select("id", "code", F.lower("code").alias("_low")).select("id", "code", F.struct(*[t.alias(n) for n, t in tried.items()]).alias("_tried"))
    found = []
    for name in only:
        seen = F.lit(0)
        for step in range(1, len(INDICATORS[name][1]) + 1):
            hit = F.get(F.col("_tried")[name]["hits"], F.lit(step - 1))
            seen = seen + hit.cast("int")
            confidence = F.round(F.col("_tried")[name]["keywords"] * 0.2 + seen * 0.3, 9)
            found.append(F.when(hit & (confidence > 0.4), F.struct(F.lit(name).alias("pattern"), F.lit(step).alias("step"), F.least(confidence, F.lit(1.0)).alias("confidence"))))
    return out.withColumn("found", F.array_compact(F.array(*found))).drop("_tried")


def _each(rows: DataFrame, array: str, *keep: str) -> DataFrame:
    """A row for each struct of the array; the outer explode keeps the optimizer from making the array once more to look for empty ones."""
    return rows.select(*keep, F.explode_outer(array).alias("_x")).filter("_x IS NOT NULL").select(*keep, "_x.*")


def design_patterns(code: DataFrame) -> DataFrame:
    """(id, pattern, category, step, confidence, line, snippet) of (id, code): the detections, each with the line, from 1 on, where its expression matches first."""
    expressions = F.create_map(*[c for name, (_, patterns) in INDICATORS.items() for c in (F.lit(name), F.array(*[F.lit(f"(?i){p}") for p in patterns]))])
    rows = _each(detected(code), "found", "id", "code")
    at = F.regexp_instr("code", F.element_at(F.element_at(expressions, F.col("pattern")), F.col("step")))
    rows = rows.withColumn("line", F.size(F.split(F.substring("code", F.lit(1), at - 1), "\n", -1)))
    snippet = F.regexp_replace(F.element_at(F.split("code", "\n", -1), F.col("line")), r"^\s+|\s+$", "")
    return rows.select("id", "pattern", category(F.col("pattern")).alias("category"), "step", "confidence", "line", snippet.alias("snippet"))


def suggestions(code: DataFrame) -> DataFrame:
    """(id, suggestion, reason, confidence): patterns that a text's counts speak for and that are not detected in it."""
    c = F.col("code")
    tests = {
        "Singleton": c.rlike(r"(?i)global|static|instance"), "Factory Method": F.regexp_count(c, F.lit(r"new\s+\w+\(")) > 3,
        "Observer": c.rlike(r"(?i)event|listener|callback|subscribe"),
        "Strategy": (F.regexp_count(c, F.lit(r"if\s*\(")) > 5) | (F.regexp_count(c, F.lit(r"switch\s*\(")) > 0), "Builder": c.rlike(r"(?i)constructor\s*\([^)]{50,}\)"),
    }
    said = lambda n: F.struct(F.lit(n).alias("suggestion"), F.lit(REASONS[n][0]).alias("reason"), F.lit(REASONS[n][1]).alias("confidence"))
    new = lambda n: ~F.exists("found", lambda d: d["pattern"] == n)
    found = F.array(*[F.when(t & new(n), said(n)) for n, t in tests.items()])
    return _each(detected(code, tuple(tests)).withColumn("said", F.array_compact(found)), "said", "id")


def improvements(code: DataFrame) -> DataFrame:
    """(id, improvement); those that a detected pattern calls for come once a detection."""
    c = F.col("code")
    lines = F.size(F.split(c, "\n", -1))
    methods = F.regexp_count(c, F.lit(METHODS))
    tests = {
        "error handling": ~c.rlike(r"(?i)try\s*\{|catch\s*\(|\.catch\s*\("), "comments": F.regexp_count(c, F.lit(r"//|/\*|\*")) < lines * 0.1,
        "long methods": (methods > 0) & (lines / F.nullif(methods, F.lit(0)) > 50), "hardcoded values": c.rlike(r"""["']\d+["']|["']\w+@\w+\.\w+["']"""),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    unsafe = F.transform(F.filter("found", lambda d: (d["pattern"] == "Singleton") & (d["confidence"] < 0.8)), lambda d: F.lit("thread safety"))
    uncleared = F.transform(F.filter("found", lambda d: (d["pattern"] == "Observer") & ~c.rlike(r"(?i)unsubscribe|removeListener")), lambda d: F.lit("unsubscribe"))
    return detected(code, ("Singleton", "Observer")).select("id", F.explode(F.concat(found, unsafe, uncleared)).alias("improvement"))


def nesting(code: Column) -> Column:
    """The greatest depth of braces; a closing one too many does not go below 0."""
    marks = F.filter(F.split(code, ""), lambda ch: ch.isin("{", "}"))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(s, ch):
        d = F.when(ch == "{", s["d"] + 1).otherwise(F.greatest(s["d"] - 1, F.lit(0)))
        return F.struct(d.alias("d"), F.greatest(s["m"], d).alias("m"))

    return F.aggregate(marks, start, step)["m"]


def duplicate_blocks(code: DataFrame) -> DataFrame:
    """(id, block, n): stretches of three lines that come back; each line trimmed, over 10 characters."""
    lines = code.select("id", F.posexplode(F.split("code", "\n", -1)).alias("at", "line")).withColumn("line", F.trim("line")).filter(F.length("line") > 10)
    order = Window.partitionBy("id").orderBy("at")
    blocks = lines.select("id", F.concat_ws("\n", "line", F.lead("line", 1).over(order), F.lead("line", 2).over(order)).alias("block"), F.lead("line", 2).over(order).isNotNull().alias("full"))
    return blocks.filter("full").groupBy("id", "block").agg(F.count("*").alias("n")).filter("n > 1")


def anti_patterns(code: DataFrame) -> DataFrame:
    """(id, pattern, severity)."""
    c = F.col("code")
    deep = nesting(c)
    blocks = duplicate_blocks(code).groupBy("id").agg(F.count("*").alias("blocks"))
    sized = code.select("id", (F.regexp_count(c, F.lit(METHODS)) > 20).alias("m"), (F.regexp_count(c, F.lit(r"this\.\w+\s*=")) > 30).alias("p"), deep.alias("deep")).join(blocks, "id", "left").na.fill(0, ["blocks"])
    fault = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("pattern"), severity.alias("severity")))
    graded = lambda grave: F.when(grave, "high").otherwise("medium")
    found = F.array(
        fault(F.col("m") | F.col("p"), "God Object", graded(F.lit(True))), fault(F.col("deep") > 5, "Spaghetti Code", graded(F.col("deep") > 7)),
        fault(F.col("blocks") > 0, "Copy-Paste Programming", graded(F.col("blocks") > 3)),
    )
    return sized.select("id", F.explode(F.array_compact(found)).alias("f")).select("id", "f.*")
