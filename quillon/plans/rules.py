"""Queries of the rule engines: pages and composed lines stand for code, groups of names for compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import code_rules as cr
from quillon.operators import composition as cm
from quillon.plans.register import query, table


# Lines of code that orders name by the remainders of their parts, so that the rules meet code and not markup alone.
SNIPPETS = [
    "class Registry { static getInstance() { return this.cache; } }", "  const a = new Widget(1);", "bus.subscribe(onChange); notifyAll(event);", "  if (ready) { run(); }",
    "switch (kind) { default: break; }", "constructor(first: string, second: string, third: string, fourth: string) {", "class CarBuilder { withDoor(n): this { return this; } build() {} }",
    "try { open('42'); } catch (e) { }", "// private static Shape instance", "class PricingStrategy { execute(order) {} }", "bus.unsubscribe(onChange);", "send('ann@example.com'); createShape(kind): Shape {",
    "abstract class WidgetFactory { create }",
]
CODE_SQL = f"""code AS (SELECT page_id AS id, html AS code FROM pages UNION ALL
SELECT -l_orderkey, string_agg(([{', '.join("'" + x.replace("'", "''") + "'" for x in SNIPPETS)}])[(l_partkey % {len(SNIPPETS)})::INTEGER + 1], chr(10) ORDER BY l_linenumber, l_partkey) FROM lineitem GROUP BY l_orderkey)"""


def code(spark, sf_dir):
    """Pages as they are, and orders (ids negated) as code of a line for each of their parts."""
    lines = table(spark, sf_dir, "lineitem").groupBy((-F.col("l_orderkey")).alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.get(F.array(*[F.lit(s) for s in SNIPPETS]), (x["l_partkey"] % len(SNIPPETS)).cast("int"))), "\n")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("code")).unionByName(lines.select("id", text.alias("code")))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found_sql(only=tuple(cr.INDICATORS)) -> str:
    """Detections (id, code, pattern, category, step, p, c) as a union over all expressions."""
    family = {n: k for k, members in cr.CATEGORIES.items() for n in members}
    parts = []
    for name in only:
        keywords, patterns = cr.INDICATORS[name]
        base = " + ".join(f"contains(lower(code), {_lit(k.lower())})::INT" for k in keywords)
        seen = []
        for step, p in enumerate(patterns, 1):
            hit = f"regexp_matches(code, {_lit(p)}, 'i')"
            seen.append(f"{hit}::INT")
            before = f"string_split_regex(code, {_lit('(?i)' + p)})[1]"
            parts.append(f"SELECT id, code, {_lit(name)} AS pattern, {_lit(family[name])} AS category, {step} AS step, len(string_split({before}, chr(10)))::INTEGER AS line, round(({base}) * 0.2::DOUBLE + ({' + '.join(seen)}) * 0.3::DOUBLE, 9) AS c FROM code WHERE {hit}")
    return f"found AS (SELECT * REPLACE (least(c, 1)::DOUBLE AS c) FROM ({' UNION ALL '.join(parts)}) WHERE c > 0.4)"


@query(rf"WITH {CODE_SQL}, {_found_sql()} SELECT id, pattern, category, step, c AS confidence, line, regexp_replace(string_split(code, chr(10))[line], '^\s+|\s+$', '', 'g') AS snippet FROM found")
def code_patterns(spark, sf_dir):
    return cr.design_patterns(code(spark, sf_dir))


COUNT = "len(regexp_extract_all(code, {0}))"
SUGGESTED = {
    "Singleton": "regexp_matches(code, 'global|static|instance', 'i')", "Factory Method": f"{COUNT.format(_lit(r'new\s+\w+\('))} > 3",
    "Observer": "regexp_matches(code, 'event|listener|callback|subscribe', 'i')", "Strategy": f"({COUNT.format(_lit(r'if\s*\('))} > 5 OR {COUNT.format(_lit(r'switch\s*\('))} > 0)",
    "Builder": f"regexp_matches(code, {_lit(r'constructor\s*\([^)]{50,}\)')}, 'i')",
}


@query(
    f"WITH {CODE_SQL}, {_found_sql(tuple(SUGGESTED))} "
    + " UNION ALL ".join(
        f"SELECT id, {_lit(n)} AS suggestion, {_lit(cr.REASONS[n][0])} AS reason, {cr.REASONS[n][1]}::DOUBLE AS confidence FROM code WHERE {t} AND id NOT IN (SELECT id FROM found WHERE pattern = {_lit(n)})" for n, t in SUGGESTED.items()
    )
)
def code_suggestions(spark, sf_dir):
    return cr.suggestions(code(spark, sf_dir))


@query(rf"""WITH {CODE_SQL}, {_found_sql(("Singleton", "Observer"))}, l AS (SELECT id, code, len(string_split(code, chr(10))) AS n, {COUNT.format(_lit(cr.METHODS))} AS m FROM code)
SELECT id, improvement FROM (SELECT id, unnest(list_filter([CASE WHEN NOT regexp_matches(code, 'try\s*\{{|catch\s*\(|\.catch\s*\(', 'i') THEN 'error handling' END,
  CASE WHEN {COUNT.format(_lit(r'//|/\*|\*'))} < n * 0.1 THEN 'comments' END, CASE WHEN m > 0 AND n / m::DOUBLE > 50 THEN 'long methods' END,
  CASE WHEN regexp_matches(code, '["'']\d+["'']|["'']\w+@\w+\.\w+["'']') THEN 'hardcoded values' END], lambda x: x IS NOT NULL)) AS improvement FROM l)
UNION ALL SELECT id, 'thread safety' FROM found WHERE pattern = 'Singleton' AND c < 0.8
UNION ALL SELECT id, 'unsubscribe' FROM found WHERE pattern = 'Observer' AND NOT regexp_matches(code, 'unsubscribe|removeListener', 'i')""")
def code_improvements(spark, sf_dir):
    return cr.improvements(code(spark, sf_dir))


def document_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code"))


@query("""WITH l AS (SELECT doc_id AS id, pos, trim(line) AS line FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) > 10),
b AS (SELECT id, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS block FROM l WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, md5(block) AS block, count(*)::BIGINT AS n FROM b WHERE block IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def dup_blocks(spark, sf_dir):
    return cr.duplicate_blocks(document_lines(spark, sf_dir)).withColumn("block", F.md5("block"))


@query(f"""WITH {CODE_SQL}, l AS (SELECT id, pos, trim(line) AS line FROM (SELECT id, unnest(range(0, len(string_split(code, chr(10))))) AS pos, unnest(string_split(code, chr(10))) AS line FROM code) WHERE length(trim(line)) > 10),
b AS (SELECT id, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS block FROM l WINDOW w AS (PARTITION BY id ORDER BY pos)),
d AS (SELECT id, count(*) AS blocks FROM (SELECT id, block FROM b WHERE block IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
m AS (SELECT id, unnest(range(0, len(marks))) AS pos, unnest(marks) AS mark FROM (SELECT id, regexp_extract_all(code, '[{{}}]') AS marks FROM code)),
s AS (SELECT id, pos, sum(CASE mark WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY pos) AS s FROM m),
n AS (SELECT id, max(s - least(0, low)) AS deep FROM (SELECT id, s, min(s) OVER (PARTITION BY id ORDER BY pos) AS low FROM s) GROUP BY 1),
f AS (SELECT id, {COUNT.format(_lit(cr.METHODS))} AS methods, {COUNT.format(_lit(r'this\.\w+\s*='))} AS fields, coalesce(deep, 0) AS deep, coalesce(blocks, 0) AS blocks FROM code LEFT JOIN n USING (id) LEFT JOIN d USING (id))
SELECT id, 'God Object' AS pattern, 'high' AS severity FROM f WHERE methods > 20 OR fields > 30
UNION ALL SELECT id, 'Spaghetti Code', CASE WHEN deep > 7 THEN 'high' ELSE 'medium' END FROM f WHERE deep > 5
UNION ALL SELECT id, 'Copy-Paste Programming', CASE WHEN blocks > 3 THEN 'high' ELSE 'medium' END FROM f WHERE blocks > 0""")
def code_anti_patterns(spark, sf_dir):
    return cr.anti_patterns(code(spark, sf_dir))


NAMES = ["Singleton", "Prototype", "Flyweight", "Factory Method", "Abstract Factory", "Observer", "Mediator", "Adapter", "Decorator", "Component", "Builder"]
KINDS = ["creational", "creational", "structural", "creational", "creational", "behavioral", "behavioral", "structural", "structural", "structural", "creational"]
SETS_SQL = f"""o AS (SELECT l_orderkey AS id, list((l_partkey % 11)::INTEGER ORDER BY l_linenumber, l_partkey) AS k FROM lineitem GROUP BY 1),
s AS (SELECT id, list_transform(k, lambda i: ({NAMES!r})[i + 1]) AS names, list_transform(k, lambda i: ({KINDS!r})[i + 1]) AS categories FROM o)"""


def sets(spark, sf_dir):
    """Orders as lists of design patterns, by the remainder of their parts."""
    pick = lambda values: F.transform("k", lambda i: F.get(F.array(*[F.lit(v) for v in values]), i))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    keyed = lines.select("id", F.transform("l", lambda x: (x["l_partkey"] % 11).cast("int")).alias("k"), F.transform("l", lambda x: (x["l_partkey"] % 3).cast("int")).alias("d"))
    described = F.transform("d", lambda i: F.get(F.array(*[F.lit(v) for v in DESCRIPTIONS]), i))
    return keyed.select("id", pick(NAMES).alias("names"), pick(KINDS).alias("categories"), described.alias("descriptions"))


def _all(pair) -> str:
    return "(" + " AND ".join(f"list_contains(names, '{n}')" for n in pair) + ")::INT"


@query(f"""WITH {SETS_SQL}, m AS (SELECT *, list_max(list_transform(list_distinct(categories), lambda c: len(list_filter(categories, lambda x: x = c)))) / len(categories)::DOUBLE AS share,
  {' + '.join(map(_all, cm.CONFLICTS))} AS violations, {' + '.join(map(_all, cm.SYNERGIES))} AS synergies, {' + '.join(map(_all, cm.CLASHES))} AS clashes FROM s)
SELECT id, violations, synergies, clashes, violations = 0 AS valid, round(greatest(0, least(100, 100 - 20 * violations + synergies * 10 + (1 - share) * 10)), 9)::DOUBLE AS score,
  array_to_string(list_filter([CASE WHEN len(names) > 5 THEN 'complexity' END, CASE WHEN share > 0.6 THEN 'balance' END], lambda x: x IS NOT NULL), ',') AS warnings FROM m""")
def composition_analysis(spark, sf_dir):
    out = cm.analysed(sets(spark, sf_dir))
    return out.select("id", "violations", "synergies", "clashes", "valid", F.round("score", 9).alias("score"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {SETS_SQL}, u AS (SELECT id, names, unnest(range(1, len(names) + 1)) AS pos, unnest(names) AS name FROM s),
r AS (SELECT *, CASE name WHEN 'Abstract Factory' THEN 'Factory Method' WHEN 'Decorator' THEN 'Component' WHEN 'Composite' THEN 'Component' END AS missing FROM u)
SELECT id, name, missing FROM r WHERE missing IS NOT NULL AND (coalesce(list_position(names, missing), 0) = 0 OR list_position(names, missing) >= pos)""")
def sequence_faults(spark, sf_dir):
    return cm.order_faults(sets(spark, sf_dir))


DESCRIPTIONS = ["hard to replace in testing", "costs performance with many parts", "as usual"]
WHAT_SQL = ", ".join(
    ["CASE WHEN len(names) > 8 THEN ['Pattern Overload', 'high', 'Architecture', 'Reduce to 3-5 essential patterns'] END"]
    + [f"CASE WHEN {_all(p)} = 1 THEN ['Pattern Conflict', 'medium', '{p[0]} + {p[1]}', 'Choose one or refactor to avoid conflict'] END" for p in cm.CLASHES]
    + [f"CASE WHEN {_all(p)} = 1 THEN ['Pattern Redundancy', 'low', '{p[1]}', 'Consider removing or consolidating'] END" for p in cm.REDUNDANT]
)


@query(f"""WITH {SETS_SQL}, r AS (SELECT id, unnest([{WHAT_SQL}]) AS f FROM s UNION ALL
SELECT l_orderkey, CASE WHEN l_partkey % 11 = 0 AND l_partkey % 3 = 0 THEN ['Singleton in Tests', 'medium', 'Singleton', 'Use dependency injection instead']
  WHEN l_partkey % 11 = 5 AND l_partkey % 3 = 1 THEN ['Observer Performance Issue', 'low', 'Observer', 'Consider event batching or filtering'] END FROM lineitem)
SELECT id, f[1] AS anti_pattern, f[2] AS severity, f[3] AS location, f[4] AS fix FROM r WHERE f IS NOT NULL""")
def composition_anti_patterns(spark, sf_dir):
    return cm.anti_patterns(sets(spark, sf_dir))
