"""Neighbours by cosine over compressed vectors, ranked again by the vectors themselves.

A unit vector is kept as a few bytes and the distance ``error`` between it and
what the bytes restore to. Two forms:

* ``ProductCodes``: a byte for each part of the vector names the nearest of at most 256
  centres of that part. A query makes one table of products for each part; a code's score
  is the sum of its entries.
* ``ByteCodes``: a byte for each place, by a step of its own; a score is one product
  of the query, scaled by the steps, with the bytes.

Codes are fitted on the bounded sample of ``vector_index``; every row is coded.

For a unit query q, a unit vector x and its restored form y, q.x lies within
``error`` = |x - y| of q.y. A search scores all codes, ranks the best few by their
vectors, and takes the k-th of those as the least that a result must have; a
second pass over the codes keeps the rows with ``q.y + margin * error`` at or above
it, as many as there are, and these are ranked by their vectors. With a margin
of 1 no neighbour is lost. The index's own margin is the share of the
error that a wanted part of the sample's true neighbours stays within; it is
measured when the index is built. In the second pass a part's vectors stand
beside its codes, so that candidates, of which there may be as many as pairs, are
ranked where they are found and only each part's k best are sent on.

Null or empty vectors, those of another size than most of the sample and those with null
or non-finite entries are in no index, and such queries find nothing. A vector of zeros has
the cosine 0 with all. Equal scores go by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.vector_index import CELLS, TRIALS, best_of, fitted_centres, nearest, sample_of, similarities, unit
from quillon.sources.shared import exists, materialise, shared_dir

#: Codes of a key: at most this many, and this many bytes of them; bytes of a key's vectors.
ROWS, BYTES, VECTORS = 131_072, 2**23, 2**25
#: Queries that are scored at once, rows for each wanted one that the first pass ranks, and what sums may differ by.
STEP, FIRST, SLACK = 512, 4, 1e-8
CODED = "id long, codes binary, error double"


class ProductCodes:
    """``state`` has the centres of each part, row after row."""

    def __init__(self, state: list, d: int):
        self.edges = np.linspace(0, d, len(state) + 1).astype(int)
        self.books = [np.asarray(s, float).reshape(-1, b - a) for s, a, b in zip(state, self.edges, self.edges[1:], strict=False)]
        self.width = len(state)

    @staticmethod
    def state(x: np.ndarray, parts: int = 8) -> list[list[float]]:
        edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        centres = max(1, min(256, len(x) // 8))
        return [fitted_centres(x[:, a:b], centres).ravel().tolist() for a, b in zip(edges, edges[1:], strict=False)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        parts = zip(self.books, self.edges, self.edges[1:], strict=False)
        return np.stack([nearest(x[:, a:b], book, 1)[:, 0] for book, a, b in parts], axis=1).astype(np.uint8)

    def restored(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(codes)))
        for j, book in enumerate(self.books):
            out += (q[:, self.edges[j] : self.edges[j + 1]] @ book.T)[:, codes[:, j]]
        return out


class ByteCodes:
    """``state`` has the least value and the step of each place."""

    def __init__(self, state: list, d: int):
        self.low, self.step = (np.asarray(s, float) for s in state)
        self.width = d

    @staticmethod
    def state(x: np.ndarray) -> list[list[float]]:
        step = (x.max(0) - x.min(0)) / 255
        return [x.min(0).tolist(), np.where(step > 0, step, 1.0).tolist()]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.low) / self.step), 0, 255).astype(np.uint8)

    def restored(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes * self.step

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (q @ self.low)[:, None] + (q * self.step) @ codes.T.astype(float)


FORMS = {"product": ProductCodes, "bytes": ByteCodes}


def margin_for(form, x: np.ndarray, k: int, recall: float) -> float:
    """The share of the error within which ``recall`` of the true neighbours of rows spread evenly over x stay; at most 1."""
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    codes = form.codes(x)
    error = np.linalg.norm(x - form.restored(codes), axis=1)
    shares = []
    for i in np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int):
        true = x @ x[i]
        true[i] = -np.inf
        near = np.argpartition(-true, k - 1)[:k]
        lost = true[near] - form.scores(x[i : i + 1], codes[near])[0]
        shares.append(np.divide(lost, error[near], out=np.zeros(k), where=error[near] > 1e-12))
    return float(np.clip(np.quantile(np.concatenate(shares), recall, method="higher"), 0.0, 1.0))


def usable(v: Column, d: int) -> Column:
    """Whether v has d finite entries."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == d) & finite, F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of equal keys that follow one another."""
    for batch in batches:
        if batch.num_rows:
            keys = batch["key"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                yield keys[first], batch.slice(first, last - first)


def _scored(shared, d: int, pick, schema: pa.Schema):
    """Runs over rows sorted by key, codes before queries; ``pick(scores, error, id, query_id, floor, x, q)`` gives the rows to send; x: the vectors beside the codes, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, codes, form = None, [], None, FORMS[shared.value[0]](shared.value[1], d)
        for at, part in _runs(batches):
            if at != key:
                key, held, codes = at, [], None
            asked = pa.compute.is_valid(part["query_id"]).to_numpy(zero_copy_only=False)
            n = int((~asked).sum())
            if n:
                held.append(part.slice(0, n))
            if n == part.num_rows or not held:
                continue
            if codes is None:
                codes = np.concatenate([np.frombuffer(b"".join(h["codes"].to_pylist()), np.uint8) for h in held]).reshape(-1, form.width)
                error, ids = (np.concatenate([h[c].to_numpy(zero_copy_only=False) for h in held]) for c in ("error", "id"))
                x = np.concatenate([_matrix(h["v"], d) for h in held]) if held[0]["v"].null_count == 0 else None
            step = max(1, min(STEP, CELLS // len(codes)))
            for first in range(n, part.num_rows, step):
                some = part.slice(first, step)
                q_id, floor = (some[c].to_numpy(zero_copy_only=False) for c in ("query_id", "floor"))
                q = _matrix(some["v"], d)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in pick(form.scores(unit(q), codes), error, ids, q_id, floor, x, q)], schema=schema)

    return run


def _first(k: int, self_pairs: bool):
    """Of each key the k best scores of a query."""

    def pick(scores, error, ids, q_id, floor, x, q):
        if not self_pairs:
            scores[q_id[:, None] == ids[None, :]] = -np.inf
        row, column = best_of(scores, ids, k)
        return q_id[row], ids[column], scores[row, column]

    return pick


def _within(margin: float, self_pairs: bool):
    """All rows that may reach the query's floor."""

    def pick(scores, error, ids, q_id, floor, x, q):
        row, column = np.nonzero(_reaching(scores, margin, error, ids, q_id, floor, self_pairs))
        return q_id[row], ids[column]

    return pick


def _ranked_within(k: int, margin: float, least: float | None, self_pairs: bool):
    """Of each key the k best, by their vectors, of the rows that may reach the query's floor."""

    def pick(scores, error, ids, q_id, floor, x, q):
        some = _reaching(scores, margin, error, ids, q_id, floor, self_pairs)
        at = np.flatnonzero(some.any(0))
        if not len(at):
            return q_id[:0], ids[:0], error[:0]
        true = similarities("cosine", x[at], q)
        true[~some[:, at] | (true < (-np.inf if least is None else least))] = -np.inf
        row, column = best_of(true, ids[at], k)
        return q_id[row], ids[at][column], true[row, column]

    return pick


def _reaching(scores, margin, error, ids, q_id, floor, self_pairs):
    scores += margin * error[None, :]
    if not self_pairs:
        scores[q_id[:, None] == ids[None, :]] = -np.inf
    return (scores >= floor[:, None] - SLACK) & (scores > -np.inf)


class CodeIndex:
    """Codes that have been written under ``path``; see ``ensure``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        head = spark.read.parquet(f"{path}/current").first()
        self.kind, self.d, self.margin, self.n = head["kind"], head["d"], head["margin"], head["n"]
        self.state = [list(s) for s in head["state"]]
        self.codes = spark.read.schema(CODED).parquet(f"{head['build']}/codes")

    @classmethod
    def ensure(cls, corpus: DataFrame, path: str | None = None, kind: str = "product", k: int = 10, recall: float = 0.95) -> CodeIndex:
        """The codes of (id, v), made if ``path`` has none. ``kind``: product or bytes."""
        path = path or f"{shared_dir(corpus.sparkSession)}/code-index-{uuid.uuid4().hex}"
        if not exists(corpus.sparkSession, f"{path}/current/_SUCCESS"):
            cls.make(corpus, path, kind, k, recall)
        return cls(corpus.sparkSession, path)

    @classmethod
    def make(cls, corpus: DataFrame, path: str, kind: str, k: int, recall: float) -> None:
        spark, build = corpus.sparkSession, f"{path}/build-{uuid.uuid4().hex}"
        data = corpus.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("v")).alias("v")).filter(F.size("v") > 0)
        rows = sample_of(data.filter(usable(F.col("v"), F.size("v"))))
        sizes = pa.compute.list_value_length(rows["v"])
        d = int(np.bincount(sizes.to_numpy()).argmax()) if rows.num_rows else 0
        data = data.filter(usable(F.col("v"), d))
        state, margin = [], 1.0
        if d:
            x = unit(_matrix(rows.filter(pa.compute.equal(sizes, d))["v"].combine_chunks(), d))
            state = FORMS[kind].state(x)
            margin = margin_for(FORMS[kind](state, d), x, k, recall)
        shared = spark.sparkContext.broadcast((kind, state))  # 256 vectors at most

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            form = FORMS[shared.value[0]](shared.value[1], d) if d else None
            for batch in batches:
                for first in range(0, len(batch), 2048):
                    part = batch.iloc[first : first + 2048]
                    x = unit(np.array(part["v"].tolist(), float))
                    codes = form.codes(x)
                    yield pd.DataFrame({"id": part["id"], "codes": [c.tobytes() for c in codes], "error": np.linalg.norm(x - form.restored(codes), axis=1)})

        data.mapInPandas(coded, CODED).write.parquet(f"{build}/codes")
        n = spark.read.schema(CODED).parquet(f"{build}/codes").count()
        head = "build string, kind string, d int, n long, margin double, state array<array<double>>"
        spark.createDataFrame([(build, kind, d, n, margin, state)], head).coalesce(1).write.mode("ignore").parquet(f"{path}/current")

    def restored(self) -> DataFrame:
        """(id, v, error): the unit vectors that the codes stand for, and how far the true ones are from them."""
        shared, d = self.spark.sparkContext.broadcast((self.kind, self.state)), self.d

        def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            form = FORMS[shared.value[0]](shared.value[1], d) if d else None
            for batch in batches:
                for first in range(0, len(batch), 2048):
                    part = batch.iloc[first : first + 2048]
                    codes = np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(-1, form.width)
                    yield pd.DataFrame({"id": part["id"], "v": list(form.restored(codes)), "error": part["error"]})

        return self.codes.mapInPandas(decoded, "id long, v array<double>, error double")

    def _pass(self, asked: DataFrame, pick, schema: str, arrow: pa.Schema, vectors: DataFrame | None = None) -> DataFrame:
        """Codes, beside ``vectors`` (id, v) if given, dealt into parts of bounded size, queries (query_id, v, floor) sent to each."""
        shared = self.spark.sparkContext.broadcast((self.kind, self.state))
        width = len(self.state) if self.kind == "product" else self.d
        rows, tasks = min(ROWS, max(1, BYTES // width)), self.spark.sparkContext.defaultParallelism
        rows = rows if vectors is None else min(rows, max(1, VECTORS // (8 * self.d)))
        parts = max(-(-self.n // rows), min(tasks, -(-self.n // 256)), 1)
        none = lambda kind: F.lit(None).cast(kind)
        coded = self.codes.withColumn("v", none("array<double>")) if vectors is None else self.codes.join(vectors, "id")
        held = coded.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("key"), none("long").alias("query_id"), "id", "codes", "error", "v", none("double").alias("floor"))
        sent = asked.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("key", "query_id", none("long").alias("id"), none("binary").alias("codes"), none("double").alias("error"), "v", "floor")
        both = held.unionByName(sent).repartition("key").sortWithinPartitions("key", F.col("query_id").isNotNull())
        return both.mapInArrow(_scored(shared, self.d, pick, arrow), schema)

    def candidates(self, corpus: DataFrame, queries: DataFrame, k: int = 10, margin: float | None = None, least: float | None = None, self_pairs: bool = False) -> DataFrame:
        """(query_id, id): the rows that a search ranks by their vectors. ``queries`` and ``corpus`` as in ``search``; with a margin of 1 there may be as many as pairs."""
        asked = self._floors(corpus, queries, k, least, self_pairs)
        ids = [("query_id", pa.int64()), ("id", pa.int64())]
        return self._pass(asked, _within(self.margin if margin is None else margin, self_pairs), "query_id long, id long", pa.schema(ids))

    def _floors(self, corpus: DataFrame, queries: DataFrame, k: int, least: float | None, self_pairs: bool) -> DataFrame:
        """(query_id, v, floor): the least score that a result of the query can have."""
        asked = queries.withColumn("floor", F.lit(None).cast("double"))
        ids = [("query_id", pa.int64()), ("id", pa.int64())]
        best = self._pass(asked, _first(FIRST * k, self_pairs), "query_id long, id long, score double", pa.schema([*ids, ("score", pa.float64())]))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= FIRST * k).select("query_id", "id")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kth = ranked(best, corpus, queries).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
        lowest = float("-inf") if least is None else least
        floor = F.greatest(F.coalesce("score", F.lit(float("-inf"))), F.lit(lowest))
        return materialise(queries.join(kth.select("query_id", "score"), "query_id", "left").select("query_id", "v", floor.alias("floor")), "floors")

    def search(self, corpus: DataFrame, queries: DataFrame, k: int = 10, margin: float | None = None, least: float | None = None, self_pairs: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the k best of (id, v) for each (query_id, v).

        ``corpus`` is the table that the index was made of. ``margin`` 1 gives
        all true neighbours; without it the measured one is taken. A query's id is unique;
        queries go to every part of the codes, so this is for a bounded set of them.
        """
        if not self.d:
            return queries.select(F.col("query_id").cast("long"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), V.doubles(F.col("v")).alias("v")).filter(usable(F.col("v"), self.d))
        floors = self._floors(corpus, asked, k, least, self_pairs)
        vectors = corpus.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("v")).alias("v"))
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        pick = _ranked_within(k, self.margin if margin is None else margin, least, self_pairs)
        found = self._pass(floors, pick, "query_id long, id long, score double", schema, vectors)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(pairs: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score): the cosines of pairs at nine places."""
    vectors = corpus.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("v")).alias("v"))
    met = pairs.join(vectors, "id").join(queries.select("query_id", F.col("v").alias("q")), "query_id")
    return met.select("query_id", "id", F.round(V.cosine(F.col("v"), F.col("q")), 9).alias("score"))
