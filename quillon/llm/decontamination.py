"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Items and documents are cut into words alike. Every window of 13 item words
holds a five-word stretch that begins at a multiple of nine, so that only those
stretches ("anchors", hashed from their words 1, 3 and 5) go into the set that
is scanned for: a set literal in the plan, tested while the words of a document
are still one array. Around an anchor found, the windows that may hold it are
written out as text and joined with the table of windows; the texts must be
equal, so a hash alone never decides. Spans of hits follow from the windows'
positions.

The anchors are counted before they go into the plan; beyond ``MAX_ANCHORS``
every window of a document is joined instead, and Spark picks the join.

A row's windows meet again by an id given in scan order, so ``docs`` should be
read from files or a written stage.

Defined cases: null and wordless texts and items have no windows; items that
are equal all count; an item of fewer than 13 words is one window; empty tables
give no rows, an empty benchmark no hits; other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import lower_ascii, materialise, read_table

WINDOW, STRIDE = 13, 9
#: Anchors that a plan may hold, and windows that may be broadcast with their texts (about 150 bytes each).
MAX_ANCHORS, MAX_BROADCAST = 50_000, 200_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: str):
    """The words of a text column after lower-casing A-Z."""
    lowered = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    return F.array_remove(F.split(lowered, BREAK, -1), "")


def anchor_hash(length: int, words: str, at: str) -> str:
    """SQL for the hash of the words 1, 3 and 5, as far as a window of ``length`` has them, from ``at`` on."""
    return f"xxhash64({', '.join(f'get({words}, {at} + {o})' for o in (0, 2, 4) if o < length)})"


def windows_of(items: DataFrame) -> DataFrame:
    """(wtext, length, items): each distinct window of (item_id, text) and the ids that hold it."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), normal_words("text").alias("w")).filter("size(w) > 0")
    spans = words.withColumn("length", F.least(F.size("w"), F.lit(WINDOW))).withColumn(
        "at", F.explode(F.expr("sequence(0, size(w) - length)"))
    )
    texts = spans.select("item_id", "length", F.expr("concat_ws(' ', slice(w, at + 1, length))").alias("wtext"))
    return texts.groupBy("wtext", "length").agg(F.collect_set("item_id").alias("items"))


def anchors_of(items: DataFrame) -> DataFrame:
    """(length, anchor): the distinct anchors of the items."""
    words = items.select(normal_words("text").alias("w")).filter("size(w) > 0").withColumn("length", F.least(F.size("w"), F.lit(WINDOW)))
    starts = words.withColumn("at", F.explode(F.expr(f"if(length < {WINDOW}, array(0), sequence(0, size(w) - 5, {STRIDE}))")))
    parts = F.coalesce(*[F.when(F.col("length") == n, F.expr(anchor_hash(n, "w", "at"))) for n in range(1, WINDOW + 1)])
    return starts.select("length", parts.alias("anchor")).distinct()


def candidate_windows(length: int, anchors: list[int] | None) -> str:
    """SQL for the array of (at, length, wtext) that a document's words ``w`` may share with a window."""
    starts = f"if(size(w) < {length}, array(), sequence(0, greatest(size(w) - {length}, 0)))"
    if anchors is not None:
        listed = ", ".join(f"{a}L" for a in anchors)
        span = 5 if length == WINDOW else length
        hits = f"filter(if(size(w) < {length}, array(), sequence(0, greatest(size(w) - {span}, 0))), i -> {anchor_hash(length, 'w', 'i')} in ({listed}))"
        starts = hits
        if length == WINDOW:
            around = f"flatten(transform({hits}, i -> transform(sequence(0, {STRIDE - 1}), o -> i - o)))"
            starts = f"filter(array_distinct({around}), s -> s >= 0 and s <= size(w) - {length})"
    return f"transform({starts}, s -> named_struct('at', s, 'length', {length}, 'wtext', concat_ws(' ', slice(w, s + 1, {length}))))"


def find_hits(docs: DataFrame, items: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(_row, *carry, n_words, spans, items) for every row of (*carry, text).

    spans: sorted array of (at, length) in words; items: sorted ids, as strings.
    """
    counted = {r[0]: r[1] for r in anchors_of(items).groupBy("length").count().collect()}  # 13 rows at most
    windows = windows_of(items)
    listed: dict[int, list[int] | None] = dict.fromkeys(counted)
    if sum(counted.values()) <= MAX_ANCHORS:
        listed = {n: [] for n in counted}
        for n, a in anchors_of(items).collect():
            listed[n].append(a)
    if sum(counted.values()) * STRIDE <= MAX_BROADCAST:  # nine windows to an anchor at most, and few more at the ends
        windows = F.broadcast(windows)
    cut = docs.select(F.monotonically_increasing_id().alias("_row"), *carry, normal_words("text").alias("w"))
    found = [F.expr(candidate_windows(n, a)) for n, a in sorted(listed.items())]
    if not found:
        none = F.array().cast("array<struct<at:int,length:int>>")
        return cut.select("_row", *carry, F.size("w").cast("long").alias("n_words"), none.alias("spans"), F.array().cast("array<string>").alias("items"))
    rows = cut.select("_row", *carry, F.size("w").cast("long").alias("n_words"), F.concat(*found).alias("_c"))
    rows = rows.withColumn("_c", F.explode_outer("_c")).select("_row", *carry, "n_words", "_c.*")
    # rows without candidates get texts of their own, which no window has
    rows = rows.withColumn("wtext", F.coalesce("wtext", F.concat(F.lit("\x01"), F.col("_row").cast("string"))))
    hits = rows.join(windows, ["wtext", "length"], "left")
    return hits.groupBy("_row", *carry, "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("at", "length")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def judged(hits: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated."""
    covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.at, s.at + s.length - 1)))))")
    return hits.withColumn("n_hit", covered.cast("long")).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = judged(find_hits(docs, read_table(spark, sf_dir, "benchmark")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def remove_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(_row, doc_id, clean_words): the normalised words of each row without those hit."""
    # numbered once and written, as another reading may number rows otherwise
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("_id"), "doc_id", "text"), "numbered")
    hits = find_hits(rows, items, ("_id",)).withColumn("hit", F.expr("array_distinct(flatten(transform(spans, s -> sequence(s.at, s.at + s.length - 1))))"))
    words = rows.select(F.col("_id").alias("_row"), "doc_id", normal_words("text").alias("w"))
    left = F.expr("filter(w, (x, i) -> not array_contains(hit, i))")
    return words.join(hits.select(F.col("_id").alias("_row"), "hit"), "_row").select("_row", "doc_id", F.when(F.size("hit") == 0, F.col("w")).otherwise(left).alias("clean_words"))


OP5_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[a:a + l - 1], ' ') AS t FROM (
    SELECT item_id, w, least(len(w), {WINDOW}) AS l, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS a FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, doc_id, l, a, array_to_string(w[a:a + l - 1], ' ') AS t FROM (
    SELECT r, doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS a FROM w, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
h AS (SELECT dw.r, dw.l, dw.a, iw.item_id FROM dw JOIN iw ON dw.l = iw.l AND dw.t = iw.t),
n AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(a, a + l)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w.w), false) AS contaminated
FROM w LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""
