"""Catalog files into a versioned store, as one flow: read, reject, take in, link by id or name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.versioned_store import VersionedStore
from quillon.sources import catalog_json as cj
from quillon.sources.shared import materialise

ENTRIES = "id string, name string, category string, description string, complexity string, tags string, file string, version long"
LINKS = "id string, src string, dst string, type string, strength double, version long"


class Seed:
    """The stores of entries and links under one folder."""

    def __init__(self, spark: SparkSession, at: str, buckets: int = 64):
        schema = lambda ddl: spark.createDataFrame([], ddl).schema
        self.spark = spark
        self.entries = VersionedStore(spark, f"{at}/entries", schema(ENTRIES), buckets=buckets)
        self.links = VersionedStore(spark, f"{at}/links", schema(LINKS), buckets=buckets)

    def load(self, path: str, version: int) -> dict[str, int]:
        """Takes the files in as ``version``; returns entries, rejected, buckets and link_buckets.

        A link stands if its target is among the file's entries or the store's. Files whose rows are
        all older than the store's leave it as it is. Unreadable files and entries without id,
        name, category or description are rejected and counted.
        """
        read = materialise(cj.read_catalog(self.spark, path), "catalog")
        good, bad = cj.required(read.filter("_corrupt is null"))
        counts = {"entries": good.count(), "rejected": bad.count() + read.filter("_corrupt is not null").count()}
        rows = cj.written(cj.with_lists(good)).withColumns({"file": F.col("_file"), "version": F.lit(version).cast("long")})
        counts["buckets"] = self.entries.upsert(rows)["buckets"]
        found = self._links(good).withColumns({"id": F.concat_ws(">", "src", "dst"), "version": F.lit(version).cast("long")})
        counts["link_buckets"] = self.links.upsert(found)["buckets"]
        return counts

    def _links(self, good: DataFrame) -> DataFrame:
        """Links of the new entries to entries of the store, which has them all by now."""
        none = F.lit(None).cast(good.schema["relationships"].dataType)
        others = self.entries.read().select("id", "name", none.alias("relationships")).join(good.select("id"), "id", "left_anti")
        return cj.links(good.select("id", "name", "relationships").unionByName(others))

    def file_of(self) -> DataFrame:
        """(id, file): which file each entry has come from."""
        return self.entries.read().select("id", "file")
