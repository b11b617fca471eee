"""Percentiles and distinct counts of large keys: exact by range partitions, and by sketches that merge.

Exact: equal values are counted first; the counts are sorted by (key, value)
into ranges and written. A range's total for each of its keys is a small table,
whose running sums tell in which range a rank lies. Only those ranges are
ranked, each by itself, so that no task holds a key's values, however many it has.

Sketches: one row for each key and unit of time, kept; any span of time is a
merge of rows. KLL sketches of the default size of 200 give ranks within about
1.33 % of the count (with 99 % confidence; less for larger sizes) and HyperLogLog sketches of 2^lg
registers give distinct counts within about 1.04 / 2^(lg / 2) (one standard
error; 1.6 % at 12).

Null values do not count; a key without values is not in the results. Null keys are a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import materialise

KLL_SIZE, HLL_LG = 200, 12


def exact_percentiles(events: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(*by, n, one column for each share): the element at floor(n * share) of a key's sorted values."""
    counted = events.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranges = counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id())
    ranges = materialise(ranges, "ranges")  # a second sort might cut the ranges elsewhere
    totals = ranges.groupBy(*by, "_part").agg(F.sum("_c").alias("_sum"))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    placed = totals.withColumns({"_from": F.sum("_sum").over(upto) - F.col("_sum"), "n": F.sum("_sum").over(Window.partitionBy(*by))})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("at")) for name, p in shares.items()])
    inside = F.filter(wanted, lambda w: (w["at"] >= F.col("_from")) & (w["at"] < F.col("_from") + F.col("_sum")))
    placed = placed.withColumn("_want", inside).filter(F.size("_want") > 0).select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_part").alias("_p"), "_from", "n", "_want")
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    rows = ranges.join(placed, same).drop("_p", *[f"_{b}" for b in by])
    within = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.col("_from") + F.sum("_c").over(within))
    hit = lambda name: F.max(F.when(F.exists("_want", lambda w: (w["name"] == name) & (w["at"] < F.col("_to")) & (w["at"] >= F.col("_to") - F.col("_c"))), F.col(value))).alias(name)
    return rows.groupBy(*by).agg(F.max("n").alias("n"), *[hit(name) for name in shares])


def sketched(events: DataFrame, by: list[str], value: str, distinct: str, size: int = KLL_SIZE, lg: int = HLL_LG) -> DataFrame:
    """(*by, n, values, ids): sketches of a double and of the distinct values of another column, a row for each key."""
    return events.groupBy(*by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("values"), F.hll_sketch_agg(distinct, F.lit(lg)).alias("ids"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of fewer keys, from kept ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("ids").alias("ids"))


def estimated(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Replaces ``values`` and ``ids`` by a column for each share and by ``distinct``; null for keys without values."""
    at = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("values", F.lit(p)))
    rest = [c for c in sketches.columns if c not in ("values", "ids")]
    return sketches.select(*rest, *[at(p).alias(name) for name, p in shares.items()], F.hll_sketch_estimate("ids").alias("distinct"))


def rank_error(estimate: Column, values: Column, share: float) -> Column:
    """How far an estimate's place lies from ``share``, as a share of the rows of a group; 0 if the share lies between its ties."""
    below, upto = F.avg((values < estimate).cast("int")), F.avg((values <= estimate).cast("int"))
    return F.greatest(below - share, F.lit(share) - upto, F.lit(0.0))
