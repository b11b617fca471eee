"""Secret scans over an incremental ledger of blobs.

A text is a blob, addressed by its SHA-256; a path (document, or document and
version) points to one. The ledger is a folder with a row for each blob and round: the rule
versions that it was scanned with then, and their findings. A round takes the distinct blobs, of
each only the rules it has not yet met, appends to the ledger, and joins the ledger's findings
of the current rules back to all paths. Exact copies, however many, are therefore scanned
once, and a new rule version touches old blobs with that rule only. Paths of blobs with very many
of them are spread over several copies of the blob's findings.

Positions come from built-in functions: a regular expression cuts a text into
the matches and what lies between; running sums over their lengths, in a window
over the blobs that have matches, give start and end in code points.

Defined cases: a null text is the empty blob; null or repeated paths are rows
like others; empty tables give no rows; the ledger may be absent; further
columns of the paths are kept.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise, read_table, shared_dir


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules first. A run of 16 hexadecimal digits is the leftmost maximal run,
#: so the least length may stand in the pattern; group 2 of an assignment must be
#: measured after matching, as a short one uses up the text it covers.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hosted", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
FINDINGS = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint,rule:string>>"
#: Paths of one blob that are joined in one place, at least; blobs with more may be this many at most.
CROWD, CROWDS = 1000, 100_000


def addressed(paths: DataFrame) -> DataFrame:
    """Adds ``blob`` to (..., text)."""
    return paths.withColumn("blob", F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256))


def unseen_blobs(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo): the distinct blobs that some rule has not scanned, and those rules."""
    blobs = addressed(paths.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))).select("blob", "text").dropDuplicates(["blob"])
    return left_to_do(blobs, ledger, rules)


def left_to_do(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Of some different blobs: those that some rule has not scanned, with these rules as ``todo``."""
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("_seen"))  # a row for each round
    left = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("_seen", F.array().cast("array<string>"))))
    return left.filter(F.size("todo") > 0).drop("_seen")


def _measured(kind_no: int, least: int):
    """The lengths of one match and of what lies before it."""
    return lambda x, at: F.struct(
        F.lit(kind_no).alias("kind_no"), at.alias("at"), F.length(x["before"]).cast("long").alias("gap"),
        F.length(x["m"]).cast("long").alias("len"), (F.length(x["g"]) >= least).alias("ok"),
    )


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, kind, kind_no, start, end): the findings in (blob, text, todo)."""
    found = blobs.withColumns(
        {f"_m{i}": F.when(F.array_contains("todo", r.name), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))) for i, r in enumerate(rules)}
    )
    some = F.lit(False)
    for i in range(len(rules)):
        some = some | F.coalesce(F.size(f"_m{i}") > 0, F.lit(False))
    found = found.filter(some)
    parts = []
    for i, r in enumerate(rules):
        measured = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else F.col(f"_m{i}")
        zipped = F.arrays_zip(
            F.col(f"_m{i}").alias("m"), F.slice(F.split("text", r.pattern, -1), F.lit(1), F.size(f"_m{i}")).alias("before"), measured.alias("g")
        )
        lengths = F.transform(zipped, _measured(i, r.least))
        kind = "array<struct<kind_no:int,at:int,gap:bigint,len:bigint,ok:boolean>>"
        parts.append(F.when(F.coalesce(F.size(f"_m{i}") > 0, F.lit(False)), lengths.cast(kind)).otherwise(F.array().cast(kind)))
    rows = found.select("blob", F.explode(F.concat(*parts)).alias("x")).select("blob", "x.*")
    upto = Window.partitionBy("blob", "kind_no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).filter("ok")
    kinds, names = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.name) for r in rules])
    return placed.select("blob", F.get(names, "kind_no").alias("rule"), F.get(kinds, "kind_no").alias("kind"), "kind_no", (F.col("end") - F.col("len")).alias("start"), "end")


def ledger_rows(blobs: DataFrame, findings: DataFrame) -> DataFrame:
    """(blob, rules, findings): a round's rows, also for blobs without findings; from (blob, todo) and (blob, rule, ...)."""
    got = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "kind", "end", "rule"))).alias("findings"))
    rows = blobs.select("blob", F.col("todo").alias("rules")).join(got, "blob", "left")
    return rows.withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))


def ledger_in(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(f"blob string, rules array<string>, findings {FINDINGS}").parquet(folder) if there else None


def by_path(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``findings`` of the rules, sorted, to the paths (..., blob); one row for each path."""
    names = F.array(*[F.lit(r.name) for r in rules])
    found = ledger.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    found = found.withColumn("findings", F.sort_array(F.filter("findings", lambda x: F.array_contains(names, x["rule"])))).filter(F.size("findings") > 0)
    n = paths.count()
    crowd = max(CROWD, n // CROWDS)
    crowded = paths.groupBy("blob").count().filter(F.col("count") > crowd).select("blob", F.ceil(F.col("count") / crowd).alias("_parts"))  # at most CROWDS
    crowded = F.broadcast(materialise(crowded, "crowded"))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = paths.join(crowded, "blob", "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts)).drop("_parts")
    copied = found.join(crowded, "blob", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(copied, ["blob", "_part"], "left").drop("_part").withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))


def scan_round(paths: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The paths (..., text) without their texts, with blob and findings; the ledger in ``folder`` is extended by what it lacks."""
    spark = paths.sparkSession
    listed = materialise(addressed(paths).drop("text"), "paths")
    ledger = ledger_in(spark, folder)
    todo = left_to_do(listed.select("blob").distinct(), ledger, rules)
    ledger_rows(todo, scan(unseen_blobs(paths, ledger, rules), rules)).write.mode("append").parquet(folder)
    return by_path(listed, ledger_in(spark, folder), rules)


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first round over ``documents``, with a ledger of its own."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = scan_round(docs, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = "filter(findings, x -> x.kind_no < 3)"
    counts = {f"n_{r.kind}": F.expr(f"cast(size(filter(findings, x -> x.kind_no = {i})) as bigint)") for i, r in enumerate(RULES[:3])}
    return paths.withColumns(counts | {"base_sha256": F.sha2(F.expr(joined.format(base)), 256), "spans": F.expr(joined.format("findings"))}).select(
        "doc_id", *counts, "base_sha256", "spans"
    )


def op6_sql() -> str:
    """DuckDB SQL for the same rows: matches are placed by the lengths of what a split leaves between them."""
    parts, lists = [], []
    for i, r in enumerate(RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"regexp_extract_all(t, {pattern}) AS m{i}, regexp_extract_all(t, {pattern}, {r.group}) AS g{i}, string_split_regex(t, {pattern}) AS s{i}")
        before = f"(list_sum(list_transform(s{i}[:j], lambda x: len(x))) + coalesce(list_sum(list_transform(m{i}[:j - 1], lambda x: len(x))), 0))::BIGINT"
        lists.append(
            f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda j: len(g{i}[j]) >= {r.least}),"
            f" lambda j: {{'start': {before}, 'no': {i}, 'mark': '{r.kind}:' || {before} || ':' || ({before} + len(m{i}[j]))}})"
        )
    mark = "array_to_string(list_transform({}, lambda x: x.mark), ',')"
    count = "len(list_filter(f, lambda x: x.no = {}))::BIGINT"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(parts)} FROM d), "
        f"f AS (SELECT doc_id, list_sort(flatten([{', '.join(lists)}])) AS f FROM m) "
        f"SELECT doc_id, {count.format(0)} AS n_assign, {count.format(1)} AS n_access, {count.format(2)} AS n_hex, "
        f"sha256(coalesce({mark.format('list_filter(f, lambda x: x.no < 3)')}, '')) AS base_sha256, coalesce({mark.format('f')}, '') AS spans FROM f"
    )
