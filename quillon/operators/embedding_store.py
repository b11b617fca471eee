"""Vectors of texts, kept by content: only texts that the store lacks are embedded.

The store is a folder of batches, each written once: ``batches/batch=<id>`` holds (hash, v) for
the texts that a run had to embed, ``quarantine/batch=<id>`` what no provider could. A
batch counts when its name is in ``log``, which is written last; what a run that died left
behind is never read. Texts are told by the SHA-256 of the text and the model's
name, so that equal texts of many rows, or of another table, are embedded once.

A provider is (name, function of a text column to a vector column). They are tried in turn: a text
whose vector is null, of another size or not finite goes to the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.hashing import hash_embedding
from quillon.operators.inverted_index import exists
from quillon.sources.shared import materialise, removed

Provider = tuple[str, Callable[[Column], Column]]
VECTORS, REFUSED = "hash string, provider string, v array<double>", "hash string, text string, fault string"


class EmbeddingStore:
    """A store under ``path`` for vectors of ``size`` entries of one ``model``."""

    def __init__(self, spark: SparkSession, path: str, size: int = 384, model: str = "hash", providers: Sequence[Provider] = (("hash", hash_embedding),)):
        self.spark, self.path, self.size, self.model, self.providers = spark, path, size, model, tuple(providers)

    def _batches(self, kind: str, schema: str) -> DataFrame:
        """What counts: the batches that the log names."""
        if not exists(self.spark, f"{self.path}/log/_SUCCESS"):
            return self.spark.createDataFrame([], schema)
        names = [r["batch"] for r in self.spark.read.parquet(f"{self.path}/log").select("batch").distinct().collect()]  # one for each run
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/batch={b}" for b in names])

    def vectors(self) -> DataFrame:
        """(hash, provider, v)."""
        return self._batches("batches", VECTORS)

    def quarantine(self) -> DataFrame:
        """(hash, text, fault): texts without a vector."""
        return self._batches("quarantine", REFUSED)

    def runs(self) -> DataFrame:
        """(batch, at, embedded, refused): what each run did."""
        return self.spark.read.parquet(f"{self.path}/log")

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.model}:{self.size}:"), text), 256)

    def _fault(self, v: Column) -> Column:
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return F.when(v.isNull(), "no vector").when(F.size(v) != self.size, F.format_string("%d entries", F.size(v))).when(~finite, "an entry is not finite")

    def ensure(self, texts: DataFrame) -> tuple[int, int]:
        """Embeds the texts of (text, ...) that are new; returns how many got a vector and how many were refused.

        Refused texts are not tried again by later runs. Null texts have no vector.
        """
        batch = uuid.uuid4().hex
        wanted = texts.select("text").filter("text is not null").distinct().withColumn("hash", self.key(F.col("text")))
        known = self.vectors().select("hash").unionByName(self.quarantine().select("hash"))
        left = materialise(wanted.join(known, "hash", "left_anti"), "texts-to-embed")
        kept, rest, written = None, left.withColumn("fault", F.lit(None).cast("string")), [left]
        for name, embed in self.providers:
            tried = materialise(rest.select("hash", "text", embed(F.col("text")).cast("array<double>").alias("v")), "tried")
            written.append(tried)
            judged = tried.withColumn("fault", self._fault(F.col("v")))
            good = judged.filter("fault is null").select("hash", F.lit(name).alias("provider"), "v")
            kept = good if kept is None else kept.unionByName(good)
            rest = judged.filter("fault is not null").select("hash", "text", "fault")
        kept.write.parquet(f"{self.path}/batches/batch={batch}")
        rest.select("hash", "text", "fault").write.parquet(f"{self.path}/quarantine/batch={batch}")
        done = self.spark.read.schema(VECTORS).parquet(f"{self.path}/batches/batch={batch}").count()
        refused = self.spark.read.schema(REFUSED).parquet(f"{self.path}/quarantine/batch={batch}").count()
        row = self.spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("at"), F.lit(done).alias("embedded"), F.lit(refused).alias("refused"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        for df in written:
            removed(df)
        return done, refused

    def joined(self, rows: DataFrame) -> DataFrame:
        """Adds ``v`` to (text, ...): from the store alone, null where it has none."""
        return rows.withColumn("_hash", self.key(F.col("text"))).join(self.vectors().select(F.col("hash").alias("_hash"), "v"), "_hash", "left").drop("_hash")
