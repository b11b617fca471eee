"""Lexical retrieval: BM25, TF-IDF and field-weighted matching, for batches of queries.

Documents are (id, text), queries (query_id, text). Postings are made only for
terms that some query has; the terms are broadcast where their number is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import bm25_tokens, sparse_tokens

#: Query terms that may be broadcast.
MAX_TERMS = 500_000


def sized_broadcast(df: DataFrame, most: int = MAX_TERMS) -> DataFrame:
    """The frame with a broadcast hint if it has ``most`` rows at most, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def as_many(df: DataFrame, as_: DataFrame, most: int = MAX_TERMS) -> DataFrame:
    """``df``, which has no more rows than ``as_``, with a broadcast hint if that has ``most`` at most: no term's postings meet in one task."""
    return F.broadcast(df) if as_.limit(most + 1).count() <= most else df


def query_terms(queries: DataFrame, tokens=bm25_tokens) -> DataFrame:
    """(query_id, term, qtf): a term counts as often as the query has it."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def postings(docs: DataFrame, terms: DataFrame | None = None, tokens=bm25_tokens) -> DataFrame:
    """(id, len, term, tf); only of ``terms`` (term), if given."""
    # an outer explode, as for an inner one the optimizer makes the tokens twice to skip empty texts
    words = docs.select("id", tokens(F.col("text")).alias("_t")).select("id", F.size("_t").alias("len"), F.explode_outer("_t").alias("term")).filter("term is not null")
    if terms is not None:
        words = words.join(sized_broadcast(terms.select("term").distinct()), "term", "left_semi")
    return words.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, tokens=bm25_tokens) -> DataFrame:
    """(n, avgdl): one row; texts without tokens count."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.coalesce(F.col("text"), F.lit(""))))).alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) for every document with a term of the query."""
    terms = query_terms(queries)
    found = postings(docs, terms)
    # a count that needs tf leaves the postings as they are, so that both uses share one shuffle
    df = found.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    stats = corpus_stats(docs)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = terms.join(df, "term").join(F.broadcast(stats)).withColumn("idf", idf)  # stats: one row
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return found.join(as_many(weights, terms), "term").groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("idf") * tf).alias("score"))


def minmax(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``norm``: scores between the least and the greatest of all documents, those without a match at 0.

    If all are equal every one is 1.
    """
    n = docs.agg(F.count("*").alias("_n"))
    ranges = scores.groupBy("query_id").agg(F.min("score").alias("_least"), F.max("score").alias("_high"), F.count("*").alias("_found"))
    low = F.when(F.col("_found") < F.col("_n"), F.least(F.lit(0.0), F.col("_least"))).otherwise(F.col("_least"))
    ranged = scores.join(ranges.join(F.broadcast(n)).withColumn("_low", low), "query_id")  # a row for each query
    span = F.col("_high") - F.col("_low")
    return ranged.withColumn("norm", F.when(span == 0, 1.0).otherwise((F.col("score") - F.col("_low")) / F.nullif(span, F.lit(0.0)))).drop(
        "_n", "_low", "_high", "_least", "_found"
    )


def top_k(scores: DataFrame, k: int, by: str = "score", key: str = "query_id", tie: str = "id") -> DataFrame:
    """Adds ``rank`` and keeps the first k of each query; ties go by id."""
    order = Window.partitionBy(key).orderBy(F.desc(by), tie)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def tfidf(docs: DataFrame, queries: DataFrame, constant_df: bool = False, corpus_size: int | None = None) -> DataFrame:
    """(query_id, id, score, norm): sum of tf * idf over the query's terms, and the score by the greatest (1 at least).

    ``constant_df`` counts a term's documents within the document itself, so that
    idf is one constant.
    """
    terms = query_terms(queries, sparse_tokens)
    found = postings(docs, terms, sparse_tokens)
    n = docs.agg(F.count("*").alias("n")) if corpus_size is None else docs.sparkSession.range(1).select(F.lit(corpus_size).cast("long").alias("n"))
    df = found.groupBy("term").agg((F.lit(1) if constant_df else F.count("*")).cast("long").alias("df"))
    weights = terms.join(df, "term").join(F.broadcast(n)).withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    scores = found.join(as_many(weights, terms), "term").groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("tf") * F.col("idf")).alias("score"))
    most = scores.groupBy("query_id").agg(F.greatest(F.max("score"), F.lit(1.0)).alias("_most"))
    return scores.join(most, "query_id").withColumn("norm", F.col("score") / F.col("_most")).drop("_most")


def field_weight(words: Column, name: Column, category: Column, text: Column) -> Column:
    """Half a point for each word in the text, one for the name, half for the category."""
    has = lambda c, w: F.contains(F.lower(c), w).cast("int")
    return F.aggregate(words, F.lit(0.0), lambda s, w: s + 0.5 * has(text, w) + 1.0 * has(name, w) + 0.5 * has(category, w))


def keyword_strength(said: Column) -> Column:
    """From reasons: 0.3, and 0.2 for each that tells of a matching word; 1 at most."""
    of_words = F.filter(said, lambda r: F.contains(F.lower(r), F.lit("contains")) | F.contains(F.lower(r), F.lit("matches")) | F.contains(F.lower(r), F.lit("keyword")))
    return F.least(F.lit(1.0), F.lit(0.3) + 0.2 * F.coalesce(F.size(of_words), F.lit(0)))


def reasons(words: Column, name: Column, text: Column, category: Column) -> Column:
    """A sentence for each word and field that holds it, in order; one default if there is none."""
    def said(w):
        return F.array(
            F.when(F.contains(F.lower(name), w), F.concat(F.lit('Name contains "'), w, F.lit('"'))),
            F.when(F.contains(F.lower(text), w), F.concat(F.lit('Description mentions "'), w, F.lit('"'))),
            F.when(F.contains(F.lower(category), w), F.concat(F.lit('Category matches "'), w, F.lit('"'))),
        )

    found = F.array_compact(F.flatten(F.transform(words, said)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Keyword match")))
