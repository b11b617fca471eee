"""Queries of the scalar text and hash functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.functions import text as T
from quillon.plans import common_sql as sql
from quillon.plans.fusion import ASKED, asked
from quillon.plans.register import query, table


@query(f"SELECT doc_id, len({sql.tokens('text')})::INTEGER AS bm25_tokens, len({sql.sparse('text')})::INTEGER AS sparse_tokens FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.bm25_tokens(F.col("text"))).alias("bm25_tokens"), F.size(T.sparse_tokens(F.col("text"))).alias("sparse_tokens"))


HASH_SQL = "(list_reduce(list_prepend({1}::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: {2}))"


@query("SELECT p_partkey, abs(" + HASH_SQL.format("p_name", 0, "((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648") + ")::BIGINT AS h FROM part")
def rolling_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", H.rolling_hash(F.col("p_name")).alias("h"))


@query("SELECT p_partkey, " + HASH_SQL.format("p_name", 2166136261, "(xor(h, c) * 16777619) % 4294967296") + "::BIGINT AS h FROM part")
def fnv_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", H.fnv1a(F.col("p_name")).alias("h"))


@query()
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", H.base36(H.fnv1a(F.col("p_name"))).alias("key"))


@query()
def hash_embeddings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(H.hash_embedding("p_name")).alias("pos", "x")).filter("x <> 0")


@query(f"""WITH {ASKED} SELECT query_id, CASE WHEN length(text) = 0 THEN 0 ELSE round(len(list_distinct(string_split(text, '')))::DOUBLE / length(text), 9) END AS ratio, ceil(length(text) / 4)::BIGINT AS tokens,
  substr(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 1, 50) AS normal, trim(regexp_replace(text, '\\b(AND|OR|NOT)\\b', '', 'g')) AS plain,
  regexp_replace(text, '([%_\\[\\]])', '\\\\\\1', 'g') AS escaped, upper(substr(text, 1, 1)) || substr(text, 2) AS capital FROM asked""")
def query_scalars(spark, sf_dir):
    t = F.col("text")
    return asked(spark, sf_dir).select(
        "query_id", F.round(T.unique_ratio(t), 9).alias("ratio"), F.ceil(F.length(t) / 4).alias("tokens"), T.normalised_query(t).alias("normal"),
        T.without_operators(t).alias("plain"), T.escaped_like(t).alias("escaped"), T.capitalised(t).alias("capital"),
    )


SYNONYM_SQL = "MAP {" + ", ".join(f"'{k}': {v[:2]!r}" for k, v in T.SYNONYMS.items()) + "}"


@query(f"""WITH {ASKED}, w AS (SELECT query_id, text, regexp_split_to_array(lower(text), '\\s+') AS w FROM asked),
e AS (SELECT *, flatten(list_transform(w, lambda x: list_prepend(x, coalesce({SYNONYM_SQL}[x], []::VARCHAR[])))) AS x FROM w)
SELECT query_id, array_to_string(list_concat(list_concat([text], CASE WHEN len(x) > len(w) THEN [array_to_string(x, ' ')] ELSE [] END),
  CASE WHEN contains(lower(text), 'design pattern') THEN [replace(text, 'design pattern', 'software pattern'), replace(text, 'design pattern', 'architectural pattern')] ELSE [] END)[1:3], ' / ') AS variants FROM e""")
def query_expansion(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", F.array_join(T.expanded(F.col("text")), " / ").alias("variants"))


@query(r"""SELECT page_id, md5(trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), 'javascript:', '', 'gi'), 'data:text/html', '', 'gi'), 'on\w+\s*=', '', 'gi'),
  '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;'))) AS digest FROM pages""")
def sanitised_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.sanitised(F.col("html"))).alias("digest"))


LISTS = [
    (1, '["a","b"]'), (2, '"x\\ny"'), (3, "p\nq \n r"), (4, "a, b,c"), (5, "one;two; three"), (6, "single"), (7, ""), (8, None), (9, "[broken"), (10, "w" * 600), (11, "a, " + "b" * 250), (12, " [1, 2] "),
]


@query()
def parsed_lists(spark, sf_dir):
    rows = spark.createDataFrame(LISTS, "id long, raw string")
    return rows.select("id", F.array_join(T.list_values(F.col("raw")), "|").alias("listed"), F.array_join(T.list_values(F.col("raw"), always=True), "|").alias("tags"))


KEYWORDS = " + ".join(f"CASE WHEN list_contains(w, '{k}') THEN 0.2 ELSE 0 END" for k in T.SUMMARY_WORDS)


@query(rf"""WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: length(trim(regexp_replace(x, '\s+', ' ', 'g'))) > 0) AS s FROM conversations),
u AS (SELECT conv_id, turn, unnest(range(0, len(s))) AS i, len(s) AS n, unnest(s) AS x FROM s), w AS (SELECT *, regexp_split_to_array(lower(x), '\s+') AS w FROM u)
SELECT conv_id, turn, i::INTEGER AS i, round({KEYWORDS} + CASE WHEN i = 0 OR i = n - 1 THEN 0.3 ELSE 0 END + CASE WHEN len(w) BETWEEN 8 AND 20 THEN 0.2 WHEN len(w) > 25 THEN -0.1 ELSE 0 END, 9)::DOUBLE AS score FROM w""")
def sentence_scores(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sentences(F.col("text")).alias("s"))
    each = parts.select("conv_id", "turn", F.size("s").alias("n"), F.posexplode("s").alias("i", "x"))
    return each.select("conv_id", "turn", "i", F.round(T.sentence_score(F.col("x"), F.col("i"), F.col("n")), 9).alias("score"))


@query()
def key_sentences(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.key_points(F.col("text"), 200).alias("summary"))


@query("SELECT p_partkey, CASE WHEN len(list_filter(string_split(lower(p_name), ' '), lambda t: t IN ('java', 'go', 'rust') AND contains(t, 'red'))) > 0 THEN 0.8 ELSE 0.3 END::DOUBLE AS fit FROM part")
def language_fit(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.language_fit(F.split(F.lower("p_name"), " "), F.lit("Red")).alias("fit"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, json_valid(props) AS sound FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.try_parse_json("props").isNotNull().alias("sound"))
