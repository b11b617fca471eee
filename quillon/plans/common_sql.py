"""DuckDB fragments that several SQL twins share."""

TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\w\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 2)"
SPARSE = r"list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'for', 'with', 'from'))"
#: A batch of queries: the benchmark's items.
QUERIES = "SELECT item_id AS query_id, text FROM benchmark"


def tokens(column: str) -> str:
    return TOKENS.format(column)


def sparse(column: str) -> str:
    return SPARSE.format(column)


BM25 = f"""
q AS ({QUERIES}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM q) GROUP BY ALL),
dt AS (SELECT doc_id AS id, {tokens('text')} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dt),
p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, id, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)
  * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)))) AS score
  FROM p JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL),
m AS (SELECT *, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END AS norm FROM (
  SELECT *, max(score) OVER (PARTITION BY query_id) AS hi,
    CASE WHEN count(*) OVER (PARTITION BY query_id) < n THEN least(0, min(score) OVER (PARTITION BY query_id)) ELSE min(score) OVER (PARTITION BY query_id) END AS lo
  FROM s, (SELECT n FROM st)))"""
