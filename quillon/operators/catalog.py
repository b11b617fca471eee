"""Catalog operations: upserts, integrity, lookups that join children to parents."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(*predicates: Column | None) -> Column:
    """The conjunction of the predicates that are given; true if none is."""
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def add_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows, and the new ones whose key is not there."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def first_children(parents: DataFrame, children: DataFrame, on: str, order: list, k: int, fields: list[str]) -> DataFrame:
    """Adds ``children``: each parent's first k as an array of structs; empty if it has none."""
    ranked = children.withColumn("_n", F.row_number().over(Window.partitionBy(on).orderBy(*order))).filter(F.col("_n") <= k)
    lists = ranked.groupBy(on).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", *fields))), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("children"))
    return parents.join(lists, on, "left").withColumn("children", F.coalesce("children", F.array()))


def broken_in_files(entries: DataFrame, store: DataFrame) -> DataFrame:
    """Of (file, id, target) the rows whose target is neither an id of the same file nor one of the store's (id)."""
    own = entries.select("file", F.col("id").alias("target")).distinct()
    return entries.join(own, ["file", "target"], "left_anti").join(store.select(F.col("id").alias("target")), "target", "left_anti").select("file", "id", "target")


def broken_edges(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", key: str = "id") -> DataFrame:
    """Edges with an end that is no node, and which end that is."""
    ids = nodes.select(F.col(key).alias("_id"))
    lost = lambda end: edges.join(ids, F.col(end) == F.col("_id"), "left_anti").withColumn("end", F.lit(end))
    return lost(src).unionByName(lost(dst))


def sound_edges(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", key: str = "id") -> DataFrame:
    """Edges between different nodes, both of which exist, each pair once."""
    ids = nodes.select(F.col(key).alias("_id"))
    kept = edges.filter(F.col(src) != F.col(dst))
    for end in (src, dst):
        kept = kept.join(ids, F.col(end) == F.col("_id"), "left_semi")
    return kept.dropDuplicates([src, dst])
