"""The library's entry points: find, search, details, count and health over a folder of tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.hashing import hash_embedding
from quillon.operators import analysis, dense, fusion, lexical


@dataclass(frozen=True)
class Config:
    """What a search is allowed and how much it returns."""

    semantic: bool = True
    keyword: bool = True
    limit: int = 5
    leg_limit: int = 10
    least: float = 0.05
    categories: tuple[str, ...] = ()
    metric: str = "cosine"

    def __post_init__(self):
        if not (1 <= self.limit <= 100 and 1 <= self.leg_limit <= 1000):
            raise ValueError("limits must lie between 1 and 100, and 1 and 1000 for a leg")
        if self.metric not in ("cosine", "l2", "dot"):
            raise ValueError(f"unknown metric {self.metric!r}")
        if not 0 <= self.least <= 1:
            raise ValueError("the least confidence must lie between 0 and 1")
        if not (self.semantic or self.keyword):
            raise ValueError("a search needs one leg at least")


class Catalog:
    """(id, name, category, text) with vectors made from name and text, or given as (id, v)."""

    def __init__(self, items: DataFrame, vectors: DataFrame | None = None, embed=hash_embedding):
        self.items, self.embed = items, embed
        self.vectors = vectors if vectors is not None else items.select("id", embed(F.concat_ws(" ", "name", "text")).alias("v"))

    def _keyword(self, queries: DataFrame, config: Config) -> DataFrame:
        docs = self.items.select("id", F.concat_ws(" ", "name", "text", "category").alias("text"))
        scores = lexical.minmax(lexical.bm25(docs, queries), docs).select("query_id", "id", F.round("norm", 9).alias("score"))
        return lexical.top_k(self._of_categories(scores, config).filter(F.col("score") >= config.least), config.leg_limit)

    def _semantic(self, queries: DataFrame, config: Config) -> DataFrame:
        corpus = self.vectors
        if config.categories:
            corpus = corpus.join(self.items.filter(F.col("category").isin(*config.categories)).select("id"), "id", "left_semi")
        asked = queries.select("query_id", self.embed("text").alias("v"))
        return dense.knn(corpus, asked, config.leg_limit, config.metric, least=config.least, self_pairs=True)

    def _of_categories(self, scores: DataFrame, config: Config) -> DataFrame:
        return scores.join(self.items.filter(F.col("category").isin(*config.categories)).select("id"), "id", "left_semi") if config.categories else scores

    def search(self, queries: DataFrame, mode: str = "hybrid", config: Config | None = None) -> DataFrame:
        """(query_id, id, semantic, keyword, confidence, rank) of keyword, semantic or hybrid search for (query_id, text)."""
        config = config or Config()
        config = {"keyword": replace(config, semantic=False, keyword=True), "semantic": replace(config, semantic=True, keyword=False), "hybrid": config}[mode]
        empty = queries.sparkSession.createDataFrame([], "query_id long, id long, score double")
        semantic = self._semantic(queries, config) if config.semantic else empty
        keyword = self._keyword(queries, config) if config.keyword else empty
        found = fusion.blend(semantic, keyword, analysis.dynamic_alpha(queries)).withColumn("confidence", F.round("confidence", 9))
        order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id")
        return found.filter(F.col("confidence") >= config.least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.limit)

    def find(self, queries: DataFrame, config: Config | None = None) -> DataFrame:
        """Recommendations: hits with their details and what speaks for them."""
        hits = self.search(queries, "hybrid", config).join(queries.withColumnRenamed("text", "query"), "query_id").join(self.items, "id")
        why = lexical.reasons(F.filter(F.split(F.lower("query"), r"\s+", -1), lambda w: F.length(w) > 2), F.col("name"), F.col("text"), F.col("category"))
        fit = F.format_string("This %s entry addresses your need for: %s", F.lower("category"), F.lower("query"))
        return hits.select("query_id", "rank", "id", "name", "category", "confidence", why.alias("reasons"), fit.alias("fit"))

    def details(self, ids: DataFrame, near: int = 3) -> DataFrame:
        """(id, kind, hit): the entry, or for unknown ids, taken as texts, the nearest ones."""
        found = ids.join(self.items.select(F.col("id").alias("hit")), F.col("id") == F.col("hit")).select("id", F.lit("found").alias("kind"), "hit")
        lost = ids.join(self.items.select(F.col("id").alias("hit")), F.col("id") == F.col("hit"), "left_anti")
        asked = lost.select(F.col("id").alias("query_id"), self.embed(F.col("id").cast("string")).alias("v"))
        similar = dense.knn(self.vectors, asked, near, self_pairs=True)
        return found.unionByName(similar.select(F.col("query_id").alias("id"), F.lit("similar").alias("kind"), F.col("id").alias("hit")))

    def count(self, by: str | None = None) -> DataFrame:
        return self.items.agg(F.count("*").alias("n")) if by is None else self.items.groupBy(by).agg(F.count("*").alias("n"))

    def health(self) -> DataFrame:
        """One row: entries, vectors, coverage and the status that follows."""
        n = self.items.agg(F.count("*").alias("items"))
        both = n.join(F.broadcast(self.vectors.agg(F.count("*").alias("vectors"))))
        share = F.coalesce(F.try_divide("vectors", "items"), F.lit(0.0))
        status = F.when(share >= 0.9, "healthy").when(share >= 0.5, "degraded").otherwise("unhealthy")
        return both.withColumns({"coverage": share, "status": status})


def parts(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of parts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return Catalog(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_type").alias("text")))
