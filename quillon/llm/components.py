"""Connected components of links by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of (a, b): the least node that each can reach.

    Each round takes the least label among a node and its neighbours, then the
    label's own label, so that rounds grow as the logarithm of a component's
    diameter. Aggregates are partial before they are shuffled; every round is
    written to the shared folder.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jumped = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left").select(
            "node", "was", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        found = materialise(jumped, "labels")
        changed = found.filter(F.col("label") != F.col("was")).limit(1).count()
        labels = found.select("node", "label")
        if not changed:
            return labels
