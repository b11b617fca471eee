"""A training corpus from documents: five stages, each with an operator of the corpus subpackage.

toxicity            documents with a score of one half or more go
near_duplicates     of every group of near-duplicates the document with the least id stays
decontamination     documents that a benchmark contaminates go
source_mix          documents appear not at all, once or twice, as the mix starts them;
                    those without words appear once
sharding            rows get shard and slot

Every stage reads what the one before has written, and all of it. Rows without
an id are told apart by their text. A stage that is given no rows returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import MAX_IDS, materialise, picked, read_table, text_key, word_count
from quillon.llm.decontamination import find_hits, judged
from quillon.llm.mixing import mix_sources
from quillon.llm.near_duplicates import near_duplicates
from quillon.llm.sharding import feistel_shards
from quillon.llm.toxicity import learned


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scorer = learned(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return scorer.score(held).filter("score < 0.5D").select("doc.*")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept")
    return picked(docs, kept.groupBy("doc_id", "text_key").agg(F.lit(1).alias("copies"), F.count("*").alias("rows")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = find_hits(docs.select("doc_id", "text", text_key().alias("text_key")), read_table(spark, sf_dir, "benchmark"), ("doc_id", "text_key"))
    out = materialise(judged(hits).filter("contaminated").select("doc_id", "text_key").distinct(), "contaminated")
    few = out.count() <= MAX_IDS
    out = out.select(F.struct("doc_id", "text_key").alias("contaminated key"))
    here = F.struct(docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    return docs.join(F.broadcast(out) if few else out, here.eqNullSafe(out["contaminated key"]), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_key().alias("text_key"))
    _, mixed = mix_sources(sized)
    starts = lambda n: (F.col("at") + n * F.col("source_size") < F.floor("target")).cast("int")
    copies = F.when(F.col("size") > 0, starts(0) + starts(1)).otherwise(1)
    return picked(docs, mixed.groupBy("doc_id", "text_key", "source").agg(F.sum(copies).alias("copies"), F.count("*").alias("rows")), ("source",))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return feistel_shards(docs, 16)


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicate_groups), ("decontamination", decontamination),
    ("source_mix", source_mix), ("sharding", sharding),
]

#: SQL can't state the toxicity model; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
