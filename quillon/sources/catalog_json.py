"""Reading and checking catalog files: JSON documents, one or many to a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import list_values

# Relationship types and levels that a catalog may use.
RELATIONS = "similar-to complements conflicts-with depends-on extends implements uses replaces variant-of related".split()
LEVELS = ("Low", "Medium", "High", "Very High")

_S = T.StringType()
_LINK = T.StructType([T.StructField(n, k) for n, k in (("targetPatternId", _S), ("target_pattern_id", _S), ("type", _S), ("strength", T.DoubleType()), ("description", _S))])
_EXAMPLE = T.StructType([T.StructField(n, _S) for n in ("language", "code", "description")])
ENTRY = T.StructType(
    [T.StructField(n, _S) for n in ("id", "name", "category", "description", "when_to_use", "benefits", "drawbacks", "use_cases", "complexity")]
    + [T.StructField("tags", T.ArrayType(_S)), T.StructField("examples", T.MapType(_S, _EXAMPLE)), T.StructField("relationships", T.ArrayType(_LINK))]
)
FILE = T.StructType([*ENTRY.fields, T.StructField("patterns", T.ArrayType(ENTRY)), T.StructField("_corrupt", _S)])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row for every entry, with its file: single documents and files of many; unreadable ones keep their text in _corrupt."""
    files = spark.read.schema(FILE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    files = files.withColumn("_file", F.col("_metadata.file_name"))
    own = F.array(F.struct(*[F.col(f.name) for f in ENTRY.fields]))
    return files.select("_file", "_corrupt", F.explode(F.coalesce("patterns", own)).alias("e")).select("_file", "_corrupt", "e.*")


def required(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with id, name, category and description, and the others."""
    ok = F.lit(True)
    for c in ("id", "name", "category", "description"):
        ok = ok & F.col(c).isNotNull()
    return df.filter(ok), df.filter(~ok)


def faults(df: DataFrame) -> Column:
    """An entry's faults, as an array of (field, message)."""
    says = lambda when, field, message: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    tests = [says(blank(c), c, "is required") for c in ("id", "name", "category", "description", "complexity") if c in df.columns]
    if "id" in df.columns:
        tests.append(says(F.col("id").isNotNull() & ~F.col("id").rlike("^[a-z][a-z0-9-]*$"), "id", "must be lower-case letters, digits and hyphens"))
    if "complexity" in df.columns:
        tests.append(says(F.col("complexity").isNotNull() & ~F.col("complexity").isin(*LEVELS), "complexity", "is not a known level"))
    out = F.array_compact(F.array(*tests))
    if "relationships" in df.columns:
        def of_link(link):
            target = F.coalesce(link["targetPatternId"], link["target_pattern_id"])
            return F.array_compact(F.array(
                says(target.isNull() | (target == ""), "relationships", "needs a target"), says(link["type"].isNull(), "relationships", "needs a type"),
                says(~F.coalesce(link["strength"].between(0, 1), F.lit(True)), "relationships", "strength must lie between 0 and 1"),
            ))

        out = F.concat(out, F.coalesce(F.flatten(F.transform("relationships", of_link)), F.expr("array()")))
    return out


def report(df: DataFrame) -> DataFrame:
    """(id, valid, text): what is wrong with each entry, in lines."""
    lines = F.transform(faults(df), lambda f: F.concat(F.lit("- "), f["field"], F.lit(" "), f["message"]))
    return df.select("id", (F.size(lines) == 0).alias("valid"), F.when(F.size(lines) == 0, "valid").otherwise(F.array_join(lines, "\n")).alias("text"))


def links(df: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(src, dst, type, strength) of the entries: targets by id, else by name; existing ones only, each pair once."""
    raw = df.select(F.col("id").alias("src"), F.posexplode("relationships").alias("at", "r"))
    raw = raw.select("src", "at", F.coalesce("r.targetPatternId", "r.target_pattern_id").alias("to"), "r.type", F.coalesce("r.strength", F.lit(1.0)).alias("strength"))
    if allowed is not None:
        raw = raw.filter(F.col("type").isin(allowed))
    by_id = df.select(F.col("id").alias("to"), F.col("id").alias("_i")).distinct()
    by_name = df.groupBy(F.col("name").alias("to")).agg(F.min("id").alias("_n"))
    found = raw.join(by_id, "to", "left").join(by_name, "to", "left").withColumn("dst", F.coalesce("_i", "_n")).filter("dst is not null")
    from quillon.operators.catalog import keep_first

    return keep_first(found, ["src", "dst"], ["at"]).select("src", "dst", "type", "strength")


def with_lists(df: DataFrame) -> DataFrame:
    """List fields as arrays, whatever form they were written in; a missing level is Medium."""
    fields = {c: list_values(F.col(c)) for c in ("when_to_use", "benefits", "drawbacks", "use_cases") if c in df.columns}
    return df.withColumns(fields | {"complexity": F.coalesce("complexity", F.lit("Medium"))})


def examples(df: DataFrame) -> DataFrame:
    """(id, pattern_id, language, code): a row for each example, its id made from its key."""
    rows = df.select(F.col("id").alias("pattern_id"), F.explode("examples").alias("key", "e"))
    return rows.select(F.hex(F.xxhash64("pattern_id", "key")).alias("id"), "pattern_id", F.coalesce("e.language", F.col("key")).alias("language"), F.coalesce("e.code", F.lit("")).alias("code"))


def written(df: DataFrame) -> DataFrame:
    """Lists joined by commas, for stores that have no arrays."""
    return df.withColumns({f.name: F.array_join(f.name, ",") for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and f.dataType.elementType == _S})
