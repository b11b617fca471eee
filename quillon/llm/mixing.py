"""Mixing sources to target weights along a low-discrepancy schedule.

Every source's documents are laid end to end in a shuffled order (by md5 of
seed and id) and cut into blocks of equal length in words; the stream may be
passed twice. Slot i of the mix is given the point ``frac(i * golden ratio)``
(in 31-bit integers), mapped through the cumulative target weights to a source.
Slots are ranked per source and rank r takes block r of that source, so that
any stretch of the mix is close to the target weights. What the point set
leaves short of a source's target comes behind as its last slots; the last
block is cut at the target. Hence a source gives exactly the whole words of its
target, and no document more than twice its size.

Targets are ``min(2 * size, level * weight)`` with the level that spends the
budget: what resharing by weight leads to. It is found by one pass over the
sources in the order of size by weight.

Bounds: no task holds more than a chunk of slots, a hash bucket of a source (they grow in number with the rows) or
one row for each source; texts are read once for their size and never moved.

Defined cases: null and blank texts have size 0 and take no block; null
sources are one source, last in the order; ids may be null or repeated, each
row being its own document; an empty table gives no rows; further columns are
kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise, read_table, word_count

SEED = "mix-1"
WEIGHTS = (3, 1, 2)
#: Words of a block.
BLOCK = 4096
#: 2 ** 31 divided by the golden ratio, made odd.
GOLDEN, RANGE = 1327217885, 1 << 31
#: Slots that are ranked in one group, and cells that the unit interval is cut into for the lookup.
CHUNK, CELLS = 2048, 1024
#: Rows of a source that are summed in one group, about.
GROUP = 100_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, lo, hi): a row for each source; lo and hi cut 0..1 by target.

    ``sized``: source, size.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    filled = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.withColumn("w", weight).withColumns(
        {
            "_all": F.sum("source_size").over(every) * F.lit(budget),
            "_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(filled), F.lit(0.0)),
            "_full": F.coalesce(F.sum("source_size").over(filled), F.lit(0)) * F.lit(most),
        }
    )
    # the level if the sources before this one stop at their most and no other does
    levels = ranked.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_w"))
    open_ = F.col("_level") * F.col("w") <= F.col("source_size") * F.lit(most)
    level = F.max_by(F.when(open_, F.col("_level")), F.when(open_, -F.col("source_size") / F.col("w"))).over(every)
    target = F.least(F.col("source_size") * F.lit(most), F.coalesce(F.col("_lv") * F.col("w"), F.col("source_size") * F.lit(most)))
    out = levels.withColumn("_lv", level).withColumn("target", target)
    running = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("target") / F.sum("target").over(every)
    upto = F.sum("target").over(running) / F.sum("target").over(every)
    return out.withColumns({"hi": F.coalesce(F.when(F.col("target") > 0, F.least(upto, F.lit(1.0))), F.lit(0.0)), "_share": F.coalesce(F.when(F.col("target") > 0, share), F.lit(0.0))}).select(
        "source", "source_size", "target", F.greatest(F.col("hi") - F.col("_share"), F.lit(0.0)).alias("lo"), "hi"
    )


def laid_out(sized: DataFrame, seed: str = SEED, digits: int = 2) -> DataFrame:
    """Adds ``at``, the words of the source that come before the row in its shuffled stream, and ``_row``.

    A source's rows are summed in 16 ** ``digits`` groups; rows with the same id and size share one.
    """
    named = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    keyed = sized.withColumn("_h", F.md5(named))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, digits))
    before = keyed.groupBy("source", "_b").agg(F.sum("size").alias("_n")).select(
        F.col("source").alias("_s"), F.col("_b").alias("_sb"),
        (F.sum("_n").over(Window.partitionBy("source").orderBy("_b")) - F.col("_n")).alias("_before"),
    )  # 16 ** digits rows for each source
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size")
    ranked = keyed.withColumns({"_in": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "_rn": F.row_number().over(inside)})
    return (
        ranked.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
        .withColumns({"at": F.col("_in") + F.col("_before"), "_row": F.concat_ws("|", "_b", "_rn")})
        .drop("_h", "_b", "_s", "_sb", "_before", "_in", "_rn")
    )


def schedule(spark: SparkSession, targets: DataFrame, n_slots: int, block: int = BLOCK) -> DataFrame:
    """(slot, source, block): the order of the mix; a source's blocks are 0, 1, ... up to its target."""
    named = targets.withColumns({"_goal": F.floor("target"), "_need": F.ceil(F.floor("target") / F.lit(block))})
    cells = named.filter(F.col("hi") > F.col("lo")).select(
        "source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("_cell")
    )
    points = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("_u", F.expr(f"((slot % {RANGE}L) * {GOLDEN}L % {RANGE}L) / {float(RANGE)}D"))
    points = points.withColumn("_cell", F.floor(F.col("_u") * CELLS))
    hit = points.join(cells, "_cell").filter((F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi")))
    hit = hit.select("slot", "source", F.expr(f"slot div {CHUNK}").alias("_chunk"))
    before = hit.groupBy("source", "_chunk").count().select(
        F.col("source").alias("_s"), F.col("_chunk").alias("_c"), "count",
        (F.sum("count").over(Window.partitionBy("source").orderBy("_chunk")) - F.col("count")).alias("_before"),
    )
    ranked = hit.withColumn("_r", F.row_number().over(Window.partitionBy("_chunk", "source").orderBy("slot")) - 1)
    ranked = ranked.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    ranked = ranked.select("slot", "source", (F.col("_r") + F.col("_before")).alias("block"))
    got = before.groupBy("_s").agg(F.sum("count").alias("_got"))
    need = named.join(got, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    short = need.filter(F.col("_got") < F.col("_need")).select(
        "source", F.explode(F.sequence(F.col("_got"), F.col("_need") - 1)).alias("block")
    ).select((F.lit(n_slots).cast("long") + F.col("block")).alias("slot"), "source", "block")
    limits = named.select(F.col("source").alias("_s"), "_need")
    in_use = ranked.join(limits, F.col("source").eqNullSafe(F.col("_s"))).filter(F.col("block") < F.col("_need")).drop("_s", "_need")
    return in_use.unionByName(short)


def mix_sources(df: DataFrame, block: int = BLOCK, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents) of the mix of (doc_id, source, size, ...).

    pieces: slot, source, block, _row, doc_id, size, pass, from, to: words
    ``from``..``to`` of the document stand in that slot; order by slot, then by
    ``at`` + pass * source_size. documents: the rows with source_size, target,
    at, _row and ``taken``, the words that the mix takes of them, with the
    first and last slot of the schedule that has some of these.
    """
    spark = df.sparkSession
    df = materialise(df, "mix-sizes")  # narrow; the texts are not read again
    targets = materialise(source_targets(df.select("source", "size")), "mix-targets")
    total, rows = df.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    slots = schedule(spark, targets, -(-3 * total // (2 * block)) + CHUNK, block).select(F.col("source").alias("_s"), F.col("block").alias("_k"), "slot")
    goals = targets.select(F.col("source").alias("_g"), "source_size", "target")
    digits = max(2, math.ceil(math.log(max(rows / GROUP, 1), 16)))
    laid = laid_out(df, seed, digits).join(goals, F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    # a row without words keeps one entry that no slot can have
    spans = F.when(F.col("size") > 0, F.array(F.lit(0), F.lit(1)))
    passes = laid.withColumn("pass", F.explode_outer(spans)).withColumn("_at", F.col("at") + F.col("pass") * F.col("source_size"))
    blocks = passes.withColumn("block", F.explode_outer(F.when(
        F.col("_at") < F.floor("target"),
        F.sequence(F.expr(f"_at div {block}"), F.expr(f"(least(_at + size, cast(floor(target) as long)) - 1) div {block}")),
    )))
    joined = blocks.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_k")), "left").drop("_s", "_k")
    pieces = joined.withColumns(
        {
            "from": F.greatest(F.col("block") * block - F.col("_at"), F.lit(0)),
            "to": F.least(F.col("block") * block + block - F.col("_at"), F.floor("target") - F.col("_at"), F.col("size")),
        }
    )
    keys = [*df.columns, "source_size", "target", "at", "_row"]
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("to") - F.col("from"))), F.lit(0))
    return pieces, pieces.groupBy(*keys).agg(taken.cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(docs)[1].select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def op3_sql(seed: str = SEED) -> str:
    """DuckDB SQL for the same rows: targets, streams, and the schedule's slots by source."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w
  FROM d GROUP BY source),
level AS (
  SELECT 0 AS i, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(w) FROM s) AS lv
  UNION ALL
  SELECT i + 1, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
      - coalesce((SELECT sum(2.0::DOUBLE * source_size) FROM s WHERE lv * w > 2.0::DOUBLE * source_size), 0))
    / (SELECT sum(w) FROM s WHERE NOT lv * w > 2.0::DOUBLE * source_size)
  FROM level WHERE i < (SELECT count(*) FROM s) AND EXISTS (SELECT 1 FROM s WHERE lv * w <= 2.0::DOUBLE * source_size)),
t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (SELECT max(lv) FROM level)) AS target FROM s),
o AS (
  SELECT d.*, t.source_size, t.target, (sum(size) OVER (PARTITION BY d.source
    ORDER BY md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || size), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
span AS (
  SELECT source, floor(target)::BIGINT AS goal, (floor(target)::BIGINT + {BLOCK - 1}) // {BLOCK} AS need,
    sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER () AS hi, target / sum(target) OVER () AS share FROM t),
n AS (SELECT (3 * sum(size)::BIGINT + {2 * BLOCK - 1}) // {2 * BLOCK} + {CHUNK} AS slots FROM d),
point AS (SELECT i AS slot, ((i % {RANGE}) * {GOLDEN} % {RANGE}) / {RANGE}::DOUBLE AS u FROM (SELECT unnest(range((SELECT slots::BIGINT FROM n))) AS i)),
hit AS (
  SELECT slot, source, need, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k
  FROM point JOIN span ON u < least(hi, 1) AND u >= greatest(hi - share, 0)),
got AS (SELECT s.source, s.need, count(h.slot) AS found FROM span s LEFT JOIN hit h ON s.source IS NOT DISTINCT FROM h.source GROUP BY ALL),
slot AS (
  SELECT source, k, slot FROM hit WHERE k < need
  UNION ALL SELECT source, k, (SELECT slots FROM n) + k FROM (SELECT source, unnest(range(found, need)) AS k FROM got)),
ends AS (
  SELECT o.*, floor(target)::BIGINT AS goal, CASE WHEN size > 0 AND pos < floor(target) THEN pos // {BLOCK} END AS a,
    CASE WHEN size > 0 AND pos + source_size < floor(target) THEN (least(pos + source_size + size, floor(target)::BIGINT) - 1) // {BLOCK}
      WHEN size > 0 AND pos < floor(target) THEN (least(pos + size, floor(target)::BIGINT) - 1) // {BLOCK} END AS b
  FROM o)
SELECT doc_id, size, source_size, target,
  (greatest(least(goal - pos, size), 0) + greatest(least(goal - pos - source_size, size), 0))::BIGINT AS taken,
  f.slot::BIGINT AS first_slot, l.slot::BIGINT AS last_slot
FROM ends
LEFT JOIN slot f ON f.k = a AND f.source IS NOT DISTINCT FROM ends.source
LEFT JOIN slot l ON l.k = b AND l.source IS NOT DISTINCT FROM ends.source"""
