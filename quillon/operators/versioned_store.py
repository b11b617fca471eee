"""A kept table with a version to each key: an upsert writes anew only the buckets that it touches.

    data/load=<n>/bucket=<b>   rows of a bucket, as the nth load has written them
    manifest/load=<n>          (bucket, load): which load each bucket is read from

Rows are dealt to buckets by a hash of their key. An upsert keeps, for each
key, the row of the greatest version; of equal versions the row that was there,
and of equal new rows the least by its text form. It joins nothing but the
buckets that have new rows, writes them under its own number and the manifest
last: until its ``_SUCCESS`` stands, readers see the load before. A lost load
leaves files that nothing reads, and the next one writes over them. One writer
at a time.

Null keys are not stored: ``upsert`` returns how many there were. A null
version is below all others. A store without loads has no rows. The manifest
is as long as there are buckets, whatever the rows; as many buckets as leave each one
the size of a task (keys are dealt by hash, so none is larger than the others).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.shared import exists, materialise, removed

_MANIFEST = "bucket int, load int"


class VersionedStore:
    """Rows of ``schema`` under ``at``, by ``key``; ``buckets`` must stay what it was at the first load."""

    def __init__(self, spark: SparkSession, at: str, schema: T.StructType, key: str = "id", version: str = "version", buckets: int = 64):
        self.spark, self.at, self.schema, self.key, self.version, self.buckets = spark, at, schema, key, version, buckets

    def loads(self) -> list[int]:
        """Numbers of the loads that have come to their end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        numbers = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)]
        return sorted(n for n in numbers if exists(self.spark, f"{self.at}/manifest/load={n}/_SUCCESS"))

    def manifest(self, load: int | None = None) -> dict[int, int]:
        """Which load each bucket is read from, as of ``load`` (the last one)."""
        done = self.loads()
        if load is None and not done:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.at}/manifest/load={done[-1] if load is None else load}")
        return dict(map(tuple, rows.collect()))

    def _of(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.at}/data/load={n}/bucket={b}" for b, n in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, load: int | None = None) -> DataFrame:
        """All rows, as of a load (the last one)."""
        return self._of(self.manifest(load))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def upsert(self, rows: DataFrame) -> dict[str, int]:
        """Takes new rows in; returns load, buckets (written anew) and rejected (rows without a key)."""
        names = [f.name for f in self.schema.fields]
        cast = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        new = materialise(self._bucketed(cast.filter(F.col(self.key).isNotNull())), "upsert")
        rejected = cast.filter(F.col(self.key).isNull()).count()
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        before = self.manifest()
        done = self.loads()
        load = done[-1] + 1 if done else 0
        if touched:
            old = self._of({b: n for b, n in before.items() if b in set(touched)})
            both = self._bucketed(old).withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
            rank = F.struct(F.col(self.version).isNotNull(), self.version, "_old", F.to_json(F.struct(*names)))
            kept = both.groupBy("bucket", self.key).agg(F.max_by(F.struct(*names), rank).alias("_row")).select("_row.*", "bucket")
            kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.at}/data/load={load}")
            entries = sorted((before | dict.fromkeys(touched, load)).items())
            self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/manifest/load={load}")
        removed(new)
        return {"load": load, "buckets": len(touched), "rejected": rejected}
