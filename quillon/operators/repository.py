"""Edges as a table that is saved, changed and deleted from, each as a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.catalog import all_of

KEY = ["src", "dst"]


def found(edges: DataFrame, src=None, dst=None, kind: str | None = None, least: float | None = None) -> DataFrame:
    """Edges that fit all the conditions that are given."""
    return edges.filter(all_of(
        None if src is None else F.col("src") == src, None if dst is None else F.col("dst") == dst,
        None if kind is None else F.col("type") == kind, None if least is None else F.col("strength") >= least,
    ))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds src_name and dst_name from (id, name)."""
    name = lambda end: nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    return edges.join(name("src"), "src").join(name("dst"), "dst")


def saved(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the new ones, rejects with a reason): both ends must exist, a pair may stand once."""
    ids = nodes.select("id")
    known = lambda df, end: df.join(ids, F.col(end) == F.col("id"), "left_semi")
    unknown = new.join(ids, F.col("src") == F.col("id"), "left_anti").unionByName(known(new, "src").join(ids, F.col("dst") == F.col("id"), "left_anti"))
    sound = known(known(new, "src"), "dst")
    repeated = sound.join(edges.select(*KEY), KEY, "left_semi")
    fresh = sound.join(edges.select(*KEY), KEY, "left_anti")
    why = lambda df, reason: df.withColumn("reason", F.lit(reason))
    return edges.unionByName(fresh), why(unknown, "unknown end").unionByName(why(repeated, "already there"))


def updated(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with the columns of ``changes`` (src, dst, ...) put in; null leaves a value as it is."""
    fields = [c for c in changes.columns if c not in KEY]
    joined = edges.join(changes.select(*KEY, *[F.col(c).alias(f"_{c}") for c in fields]), KEY, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(*edges.columns)


def deleted(edges: DataFrame, condition: Column) -> DataFrame:
    return edges.filter(~F.coalesce(condition, F.lit(False)))
