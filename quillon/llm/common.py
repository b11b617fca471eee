"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Ids that may be broadcast to pick texts (about 50 MB); beyond, Spark joins as it sees fit.
MAX_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset on one
    machine, as in tests, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage with a copy that survives lost executors, and lets
    several consumers read one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def removed(df: DataFrame) -> None:
    """Deletes what ``materialise`` wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; the empty text for null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.expr("0L") + F.regexp_count(text, F.lit(WORD)), F.lit(0).cast("long"))


def word_list(text: Column) -> Column:
    """The words of a text in order; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; wholly ASCII texts take the faster built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def text_key() -> Column:
    """A 64-bit hash of ``text``; with the id, it tells rows apart that are not equal."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def picked(docs: DataFrame, decided: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` as often as decided, with their texts.

    ``decided``: doc_id, text_key, the columns ``also``, rows (how many rows of
    ``docs`` are equal in these) and copies (how often they appear, all together). Copies are dealt out
    evenly among rows that differ in other columns, in the order of a hash of the
    whole row; reruns agree. Columns of ``docs`` may have any names.
    """
    keys = ["doc_id", "text_key", *also]
    wanted = materialise(decided.filter("copies > 0").select(*keys, F.col("rows").cast("long").alias("rows"), F.col("copies").cast("long").alias("copies")), "wanted")
    few = wanted.count() <= MAX_IDS
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))  # so that no name of theirs is in the way
    same = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(F.col("doc.text"), F.lit(""))) == F.col("text_key"))
    for c in also:
        same = same & F.col(f"doc.{c}").eqNullSafe(F.col(c))

    def found(part: DataFrame) -> DataFrame:
        return held.join(F.broadcast(part) if few else part, same)

    # rows equal in all columns are counted before any is placed, so that no window holds them
    kinds = found(wanted.filter("rows > 1")).groupBy(*keys, F.sha2(F.to_json("doc"), 256).alias("kind"))
    kinds = kinds.agg(F.first("doc").alias("doc"), F.first("rows").alias("rows"), F.first("copies").alias("copies"), F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("kind").rowsBetween(Window.unboundedPreceding, 0))
    dealt = kinds.withColumn("upto", upto).select("doc", F.expr("(copies * upto) div rows - (copies * (upto - n)) div rows").alias("copies"))
    rows = found(wanted.filter("rows = 1")).select("doc", "copies").unionByName(dealt.filter("copies > 0"))
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def least_hashed(df: DataFrame, n: int, key: Column) -> DataFrame:
    """The n rows with the least md5 of a key, for bounded samples.

    Rows that cannot be among them are left out before the sort (four times as
    many pass as are wanted), so that a task sends a few rows and not n.
    """
    total = df.count()
    order = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    if total > 4 * n:
        df = df.filter(F.substring(order, 1, 8) < f"{int(4 * n / total * 2**32):08x}")
    return df.orderBy(order).limit(n)
