"""Tokenizers and scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the query analysis, the expansion and the summary.
TECHNICAL = (
    "pattern architecture design algorithm data structure interface abstract factory singleton observer strategy decorator adapter bridge"
    " proxy facade flyweight chain command mediator memento state template visitor iterator"
).split()
EXPLORATORY = "best good how what why explain learn understand".split()
SPECIFIC = "implement code example use apply create write".split()
ENGINE_TERMS = (
    "pattern factory singleton observer strategy adapter bridge proxy facade decorator composite iterator mediator memento state template"
    " visitor architecture design"
).split()
SPARSE_STOP = "the and for with from".split()
SYNONYMS = {
    "object": ["instance", "class", "type"],
    "create": ["instantiate", "build", "construct", "make"],
    "manage": ["handle", "control", "organize", "coordinate"],
    "data": ["information", "state", "content"],
    "user": ["client", "customer", "person"],
    "system": ["application", "software", "platform"],
    "service": ["microservice", "api", "endpoint"],
    "database": ["storage", "persistence", "data store"],
    "web": ["http", "browser", "frontend"],
    "api": ["interface", "endpoint", "service"],
    "test": ["testing", "validation", "verification"],
    "error": ["exception", "failure", "problem"],
    "async": ["asynchronous", "concurrent", "parallel"],
    "cache": ["caching", "memory", "storage"],
    "security": ["authentication", "authorization", "encryption"],
}
SUMMARY_WORDS = "pattern design structure architecture implement benefit advantage use when because purpose".split()


# Typical use cases of a category, and of any other.
USE_CASES = {
    "Creational": "Object instantiation, resource management",
    "Structural": "Class relationships, interface adaptation",
    "Behavioral": "Communication, responsibility assignment",
    "Architectural": "System organization, component interaction",
    "Cloud-Native": "Scalability, resilience, distributed systems",
    "Microservices": "Service decomposition, communication patterns",
    "AI/ML": "Model training, inference, data processing",
    "Functional": "Data transformation, immutability, composition",
    "Reactive": "Asynchronous processing, event handling",
    "Anti-Pattern": "Common mistakes to avoid",
}
OTHER_USE_CASES = "General software design"


def typical_use_cases(category: Column) -> Column:
    """What a category is typically used for."""
    table = F.create_map(*[F.lit(x) for pair in USE_CASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit(OTHER_USE_CASES))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def bm25_tokens(text: Column) -> Column:
    """Lower-cased words of three characters or more, cut at anything but ASCII word characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+", -1), lambda w: F.length(w) > 2)


def sparse_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of three characters or more, without the stop words."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+", -1), lambda w: (F.length(w) > 2) & ~w.isin(SPARSE_STOP))


def blank_words(text: Column) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(text, r"\s+", -1), lambda w: F.length(w) > 0)


def contains_any(word: Column, values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(word, F.lit(v)) for v in values])


def unique_ratio(text: Column) -> Column:
    """Distinct characters by length; 0 for the empty text."""
    n = F.length(text)
    return F.when(n > 0, F.size(F.array_distinct(F.split(text, ""))) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))


def shingles(text: Column, query_words: Column, size: int = 3) -> Column:
    """Stretches of ``size`` words that hold a query word as part of one of their words."""
    words = blank_words(F.lower(text))
    # words beside those that follow: a lambda that refers to an array outside of it makes that anew for each element
    places = [f"w{k}" for k in range(size)]
    zipped = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))).alias(p) for k, p in enumerate(places)])
    holds = lambda w: F.exists(query_words, lambda q: F.contains(w, q))
    hit = F.filter(zipped, lambda s: s[places[-1]].isNotNull() & reduce(lambda a, b: a | b, [holds(s[p]) for p in places]))
    return F.transform(hit, lambda s: F.concat_ws(" ", *[s[p] for p in places]))


def normalised_query(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 1, 50)


def query_kind(text: Column) -> Column:
    """specific for three words at most, exploratory with how, what or explain, else balanced."""
    low = F.lower(text)
    return (
        F.when(F.size(F.split(text, " ", -1)) <= 3, "specific")
        .when(contains_any(low, ["how", "what", "explain"]), "exploratory")
        .otherwise("balanced")
    )


def without_operators(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\b(AND|OR|NOT)\b", ""))


def expanded(text: Column) -> Column:
    """The query, the query with up to two synonyms behind each word, and rewordings of "design pattern"; three at most."""
    words = F.split(F.lower(text), r"\s+", -1)
    table = F.create_map(*[c for k, v in SYNONYMS.items() for c in (F.lit(k), strings(v[:2]))])
    with_synonyms = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(table, w), strings([])))))
    second = F.when(F.size(with_synonyms) > F.size(words), F.array(F.array_join(with_synonyms, " "))).otherwise(strings([]))
    reworded = F.when(
        F.contains(F.lower(text), F.lit("design pattern")),
        F.array(F.replace(text, F.lit("design pattern"), F.lit("software pattern")), F.replace(text, F.lit("design pattern"), F.lit("architectural pattern"))),
    ).otherwise(strings([]))
    return F.slice(F.concat(F.array(text), second, reworded), 1, 3)


def sentence_score(sentence: Column, index: Column, total: Column) -> Column:
    words = F.split(F.lower(sentence), r"\s+", -1)
    n = F.size(words)
    keywords = reduce(lambda a, b: a + b, [F.when(F.array_contains(words, k), 0.2).otherwise(0.0) for k in SUMMARY_WORDS])
    place = F.when((index == 0) | (index == total - 1), 0.3).otherwise(0.0)
    return keywords + place + F.when(n.between(8, 20), 0.2).when(n > 25, -0.1).otherwise(0.0)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?]+", -1), lambda s: F.length(F.trim(F.regexp_replace(s, r"\s+", " "))) > 0)


def key_points(text: Column, most: int) -> Column:
    """The best sentences in the order of their scores, until one does not fit."""
    parts = sentences(text)
    n = F.size(parts)
    scored = F.transform(parts, lambda s, i: F.struct((-F.round(sentence_score(s, i, n), 6)).alias("key"), i.alias("i"), F.trim(s).alias("s")))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(acc, x):
        fits = ~acc["full"] & (F.length(acc["out"]) + F.length(x["s"]) + 2 <= most)
        joined = F.when(F.length(acc["out"]) > 0, F.concat(acc["out"], F.lit(". "), x["s"])).otherwise(x["s"])
        return F.struct(F.when(fits, joined).otherwise(acc["out"]).alias("out"), (acc["full"] | ~fits).alias("full"))

    chosen = F.aggregate(F.array_sort(scored), start, step)["out"]
    cut = F.concat(F.substring(text, 1, most - 3), F.lit("..."))
    short = F.when(F.length(text) > most, cut).otherwise(text)
    return F.when(n <= 2, short).when(F.length(chosen) > 0, chosen).otherwise(cut)


def sanitised(text: Column) -> Column:
    """Without null bytes, scripts and event handlers, and with markup characters escaped, in that order."""
    out = F.replace(text, F.lit("\x00"), F.lit(""))
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?i)javascript:", r"(?i)data:text/html", r"(?i)on\w+\s*="):
        out = F.regexp_replace(out, pattern, "")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return F.trim(out)


def escaped_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([%_\[\]])", r"\\$1")


def list_values(raw: Column, always: bool = False) -> Column:
    """A list from JSON, lines, commas or semicolons; the first form that fits.

    Commas count for tags (``always``) and texts under 200 characters. A JSON
    string is decoded first.
    """
    as_list = F.from_json(raw, "array<string>")
    inner = F.when(raw.rlike(r'^\s*"'), F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))).otherwise(raw)
    cut = lambda by: F.filter(F.transform(F.split(inner, by, -1), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    by_comma = F.contains(inner, F.lit(",")) if always else F.contains(inner, F.lit(",")) & (F.length(inner) < 200)
    return (
        F.when(raw.isNull() | (F.trim(raw) == ""), strings([]))
        .when(raw.rlike(r"^\s*\[") & as_list.isNotNull(), F.filter(as_list, lambda s: s.isNotNull()))
        .when(F.contains(inner, F.lit("\n")), cut("\n"))
        .when(by_comma, cut(","))
        .when(F.contains(inner, F.lit(";")), cut(";"))
        .when(F.length(inner) < 500, F.array(F.trim(inner)))
        .otherwise(strings([]))
    )


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.expr("''"), F.substr(text, F.lit(2)))


def language_fit(tags: Column, language: Column) -> Column:
    """0.5 without a language, 0.8 if a language tag has its first three letters, else 0.3."""
    known = "javascript typescript python java csharp cpp go rust php ruby".split()
    start = F.lower(F.substring(language, 1, 3))
    match = F.exists(tags, lambda t: F.lower(t).isin(known) & F.contains(F.lower(t), start))
    return F.when(language.isNull() | (language == ""), 0.5).when(match, 0.8).otherwise(0.3)
