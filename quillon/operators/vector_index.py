"""Nearest neighbours over many vectors: exact in blocks, and by an inverted file of cells.

Both meet queries with vectors by a key and a shuffle: queries are rows like any others
and never pass through the driver. Within a key the vectors come first and are kept as one
matrix of ``ROWS`` rows or so; queries follow in slices, so that a matrix of
scores has ``CELLS`` entries at most. Each key sends its k best for a query.
By cosine, products in single precision tell which vectors may be among the k best (``Screen``);
these alone are scored in full, so that the result is the same.

* Exact: vectors and queries are both dealt into parts of ``ROWS``, and every part of the one
  meets every part of the other in a task of its own. All pairs of a table take the square of its rows in
  time and in parts; a task stays as large as it is.
* Index (``VectorIndex``): cells are the nearest of ``n`` centres, found by Lloyd's
  rounds on a sample of ``SAMPLE`` rows at most (those with the least hash of the id); every row of the
  table is in a cell, in parts of ``ROWS``, so that a crowded cell is many keys' work. The
  table is partitioned by the cell's group; a search reads the groups that it
  probes. A query probes its nearest cells; candidates are ranked by their exact similarity. How
  many cells a query needs for a wanted recall is measured when the index is built, on
  ``TRIALS`` rows of the sample against their exact neighbours in the sample, and kept with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.inverted_index import exists
from quillon.sources.shared import materialise, shared_dir

#: Vectors of a key (34 MB at 64 places, and half as much in single precision), scores of a matrix at once (32 MB).
ROWS, CELLS = 65_536, 4_000_000
#: Of a screen: vectors and queries of a product, vectors of which the greatest score is compared first, candidates of a query beyond which it is left to whole matrices.
BLOCK, SLICE, SPAN, MOST = 2048, 256, 32, 1024
#: Rows that centres are fitted on, and rows of those that measure the recall.
SAMPLE, TRIALS = 20_000, 500
#: Folders that the index is partitioned into, and its tables.
GROUPS = 64
CELL, SIZE = "id long, v array<double>, cell int, group int", "cell int, n long, parts int"


def similarities(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of queries (rows) against vectors (columns), at nine places."""
    product = q @ x.T
    if metric == "l2":
        squares = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * product
        product = 1 / (1 + np.sqrt(np.maximum(squares, 0)))
    elif metric != "dot":
        under = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        product = np.divide(product, under, out=np.zeros_like(product), where=under > 0)
    return np.round(product, 9)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its k best scores, and how many there are; ties go by id. Scores of -inf are none."""
    k = min(k, scores.shape[1])
    # the k-th score of each row; all that reach it are sorted, so that ties at the edge are whole
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    row, column = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
    first = first_of(row, scores[row, column], ids[column], k)
    return row[first], column[first]


def first_of(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k best scores, in order; ties go by id."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


class Screen:
    """Vectors of a key as unit vectors in single precision, in blocks, for the k best by cosine of many queries.

    A product in single precision is off by less than ``slack`` / 2. The k-th greatest of the scores that
    stand for ``SPAN`` vectors each is no more than the k-th score; what lies below it by more than ``slack`` cannot
    be among the k best. It rises from block to block. Queries for which that
    tells too little (many copies, vectors that have no unit) are returned as left over.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids, self.size = x, ids, np.linalg.norm(x, axis=1)
        self.slack = 2 * (x.shape[1] + 8) * 2.0**-23 + 1e-8
        self.fits = len(x) >= BLOCK and bool(self.plain(self.size).all())
        self.blocks = []
        for first in range(0, len(x) if self.fits else 0, BLOCK):
            block = np.zeros((x.shape[1], BLOCK), np.float32)
            some = x[first : first + BLOCK]
            block[:, : len(some)] = unit(some).T
            self.blocks.append((first, len(some), block))

    @staticmethod
    def plain(size: np.ndarray) -> np.ndarray:
        return (size == 0) | ((size > 1e-100) & (size < 1e100))

    def best(self, q: np.ndarray, q_id: np.ndarray, k: int, least: float | None, self_pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``q``, columns and scores of the k best, and the rows that are left over."""
        want, spans, n = k + (not self_pairs), BLOCK // SPAN, len(q)
        if not self.fits or want > spans // 2:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.arange(n)
        size = np.linalg.norm(q, axis=1)
        left = ~self.plain(size)
        asked = np.where(left[:, None], 0, unit(np.where(left[:, None], 0, q))).astype(np.float32)
        top, count, found = np.full((n, want), -np.inf, np.float32), np.zeros(n, int), []
        near, low = np.empty((n, BLOCK), np.float32), np.full(n, -np.inf)
        for first, m, block in self.blocks:
            np.matmul(asked, block, out=near)
            near[:, m:] = -np.inf
            spread = near.reshape(n, SPAN, spans)
            most = spread.max(1)
            top = np.partition(np.concatenate([top, most], 1), spans, axis=1)[:, spans:]
            low = top.min(1).astype(float) - self.slack
            if least is not None:
                low = np.maximum(low, least - self.slack)
            low[left] = np.inf
            row, span = np.nonzero(most >= low[:, None])
            held = spread[row, :, span]
            at, deep = np.nonzero(held >= low[row][:, None])
            found.append((row[at], first + deep * spans + span[at], held[at, deep]))
            count += np.bincount(row[at], minlength=n)
            left |= count > MOST
        row, column, score = (np.concatenate(f) for f in zip(*found, strict=True))
        may = (score >= low[row]) & ~left[row]
        row, column = row[may], column[may]
        if not self_pairs:
            own = q_id[row] == self.ids[column]
            left |= np.bincount(row[own], minlength=n) > 1  # an id of several vectors: more than one drops out
            row, column = row[~own & ~left[row]], column[~own & ~left[row]]
        under = size[row] * self.size[column]
        product = np.einsum("ij,ij->i", q[row], self.x[column])
        score = np.round(np.divide(product, under, out=np.zeros_like(product), where=under > 0), 9)
        if least is not None:
            row, column, score = row[score >= least], column[score >= least], score[score >= least]
        first = first_of(row, score, self.ids[column], k)
        return row[first], column[first], score[first], np.flatnonzero(left)


def _meets(k: int, metric: str, least: float | None, self_pairs: bool):
    """Rows (key, query_id, id, v) sorted by key, vectors (query_id null) first, to each key's k best for every query."""
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, x, screen = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch["key"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(first, last - first)
                if keys[first] != key:
                    key, ids, held, x = keys[first], [], [], None
                queries = pa.compute.is_valid(part["query_id"]).to_numpy(zero_copy_only=False)
                m = int((~queries).sum())
                if m:
                    vectors = part.slice(0, m)
                    held.append(_matrix(vectors["v"], len(vectors["v"][0])))
                    ids.append(vectors["id"].to_numpy(zero_copy_only=False))
                    x = None
                if m == part.num_rows or not held:
                    continue
                if x is None:
                    x, x_id = np.concatenate(held), np.concatenate(ids)
                    held, ids = [x], [x_id]
                    screen = Screen(x, x_id) if metric == "cosine" else None
                asked = part.slice(m)
                step = max(1, CELLS // len(x))
                for at in range(0, asked.num_rows, SLICE):
                    some = asked.slice(at, SLICE)
                    q, q_id = _matrix(some["v"], x.shape[1]), some["query_id"].to_numpy(zero_copy_only=False)
                    left = np.arange(len(q))
                    if screen is not None:
                        row, column, score, left = screen.best(q, q_id, k, least, self_pairs)
                        yield pa.RecordBatch.from_arrays([pa.array(q_id[row]), pa.array(x_id[column]), pa.array(score)], schema=schema)
                    for begin in range(0, len(left), step):
                        rest = left[begin : begin + step]
                        scores = similarities(metric, x, q[rest])
                        if not self_pairs:
                            scores[q_id[rest][:, None] == x_id[None, :]] = -np.inf
                        if least is not None:
                            scores[scores < least] = -np.inf
                        row, column = best_of(scores, x_id, k)
                        yield pa.RecordBatch.from_arrays([pa.array(q_id[rest][row]), pa.array(x_id[column]), pa.array(scores[row, column])], schema=schema)

    return run


def _met(vectors: DataFrame, queries: DataFrame, k: int, metric: str, least: float | None, self_pairs: bool, keys: int | None = None) -> DataFrame:
    """The k best of (key, id, v) for each (key, query_id, v), over all keys of a query; where ``keys`` are numbered from 0, each is a task."""
    none = F.lit(None).cast("long")
    both = vectors.select("key", none.alias("query_id"), "id", "v").unionByName(queries.select("key", "query_id", none.alias("id"), "v"))
    dealt = both.repartition("key") if keys is None else both.repartitionById(keys, F.col("key").cast("int"))
    sorted_ = dealt.sortWithinPartitions("key", F.col("query_id").isNotNull())
    found = sorted_.mapInArrow(_meets(k, metric, least, self_pairs), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", least: float | None = None, self_pairs: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k best of (id, v) for each (query_id, v); ties go by id."""
    n, m = max(1, corpus.count()), max(1, queries.count())
    wide, high = -(-n // ROWS), -(-m // ROWS)
    while wide * high < min(2 * corpus.sparkSession.sparkContext.defaultParallelism, -(-n * m // CELLS)):
        wide, high = (2 * wide, high) if n * high >= m * wide else (wide, 2 * high)
    part = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    vectors = corpus.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("v")).alias("v")).withColumn("_h", every(high))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), V.doubles(F.col("v")).alias("v")).withColumn("_w", every(wide))
    vectors = vectors.select((part("id", wide) * high + F.col("_h")).alias("key"), "id", "v")
    asked = asked.select((F.col("_w") * high + part("query_id", high)).alias("key"), "query_id", "v")
    return _met(vectors, asked, k, metric, least, self_pairs, wide * high)


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """For each row the k nearest centres, the nearest first; ties go to the lowest."""
    far = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    if k == 1:
        return far.argmin(1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def fitted_centres(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows of a sample."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        at = np.concatenate([nearest(x[i : i + 4096], centres, 1)[:, 0] for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        count = np.bincount(at, minlength=n)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def sample_of(data: DataFrame) -> pa.Table:
    """The v of the ``SAMPLE`` rows, or fewer, whose ids have the least hashes."""
    total = data.count()
    hashed = F.md5(F.col("id").cast("string"))
    rows = data if total <= 4 * SAMPLE else data.filter(F.substring(hashed, 1, 8) < f"{int(4 * SAMPLE / total * 2**32):08x}")
    return rows.orderBy(hashed).limit(SAMPLE).select("v").toArrow()


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, recall: float, trials: int = TRIALS) -> int:
    """Cells that have to be probed so that ``recall`` of the sample's exact neighbours are found, over rows spread evenly."""
    asked = np.linspace(0, len(x) - 1, min(trials, len(x))).astype(int)
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    cell = np.concatenate([nearest(x[i : i + 4096], centres, 1)[:, 0] for i in range(0, len(x), 4096)])
    order = nearest(x[asked], centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(asked), 0), axis=1)
    wanted = []
    for i, q in enumerate(asked):
        scores = x @ x[q]
        scores[q] = -np.inf
        wanted.append(place[i, cell[np.argpartition(-scores, k - 1)[:k]]])
    need = np.sort(np.concatenate(wanted))
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1


class VectorIndex:
    """An index by cosine that has been built under ``path``; see ``ensure``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        head = spark.read.parquet(f"{path}/current").first()
        self.build, self.probes, self.d = head["build"], head["probes"], head["d"]
        self.centres = np.array(head["centres"]).reshape(-1, self.d) if self.d else np.zeros((0, 0))
        self.cells = spark.read.schema(CELL).parquet(f"{self.build}/cells")
        self.sizes = spark.read.schema(SIZE).parquet(f"{self.build}/sizes")

    @classmethod
    def ensure(cls, corpus: DataFrame, path: str | None = None, k: int = 10, recall: float = 0.95, cells: int | None = None) -> VectorIndex:
        """The index of (id, v), built if ``path`` has none."""
        path = path or f"{shared_dir(corpus.sparkSession)}/vector-index-{uuid.uuid4().hex}"
        if not exists(corpus.sparkSession, f"{path}/current/_SUCCESS"):
            cls.make(corpus, path, k, recall, cells)
        return cls(corpus.sparkSession, path)

    @classmethod
    def make(cls, corpus: DataFrame, path: str, k: int, recall: float, cells: int | None) -> None:
        spark, build = corpus.sparkSession, f"{path}/build-{uuid.uuid4().hex}"
        data = corpus.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("v")).alias("v"))
        total, rows = data.count(), sample_of(data)
        d = len(rows["v"][0]) if rows.num_rows else 0
        x = unit(_matrix(rows["v"].combine_chunks(), d)) if d else np.zeros((0, 0))
        many = min(len(x), cells or max(1, min(2048, int(4 * np.sqrt(len(x)) * max(1.0, (total / max(1, len(x))) ** 0.25)), len(x) // 8 or 1)))
        centres = fitted_centres(x, many) if d else x
        probes = probes_for(x, centres, k, recall) if d else 1
        shared = spark.sparkContext.broadcast(centres)  # 2048 centres at most

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for first in range(0, len(batch), 2048):
                    part = batch.iloc[first : first + 2048]
                    yield part.assign(cell=nearest(unit(np.array(part["v"].tolist(), float)), shared.value, 1)[:, 0].astype(np.int32))

        celled = data.mapInPandas(placed, "id long, v array<double>, cell int") if d else data.withColumn("cell", F.lit(0))
        celled.withColumn("group", F.col("cell") % GROUPS).repartition("group", F.pmod(F.xxhash64("id"), F.lit(max(1, total // 10**6)))).write.partitionBy("group").parquet(f"{build}/cells")
        written = spark.read.schema(CELL).parquet(f"{build}/cells")
        sizes = written.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / ROWS).cast("int"))
        sizes.coalesce(1).write.parquet(f"{build}/sizes")
        kind = "build string, probes int, d int, centres array<double>"
        spark.createDataFrame([(build, probes, d, centres.ravel().tolist())], kind).coalesce(1).write.mode("ignore").parquet(f"{path}/current")

    def search(self, queries: DataFrame, k: int = 10, least: float | None = None, self_pairs: bool = False, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best of the probed cells for each (query_id, v), by exact cosine."""
        probes, shared = min(probes or self.probes, max(1, len(self.centres))), self.spark.sparkContext.broadcast(self.centres)

        def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for first in range(0, len(batch), 1024):
                    part = batch.iloc[first : first + 1024]
                    cells = nearest(unit(np.array(part["v"].tolist(), float)), shared.value, probes)
                    yield part.loc[part.index.repeat(cells.shape[1])].assign(cell=cells.ravel().astype(np.int32))

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), V.doubles(F.col("v")).alias("v"))
        if not self.d:
            return asked.select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        sent = asked.mapInPandas(probed, "query_id long, v array<double>, cell int")
        # sizes has a row for each of 2048 cells at most; a crowded cell's parts all get the query
        parts = sent.join(F.broadcast(self.sizes.select("cell", "parts")), "cell")
        asked_at = parts.select("query_id", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cell")
        probed_cells = materialise(sent.select("cell").distinct(), "probed").withColumn("group", F.col("cell") % GROUPS)
        held = self.cells.join(F.broadcast(probed_cells), ["group", "cell"], "left_semi").join(F.broadcast(self.sizes.select("cell", "parts")), "cell")
        key = lambda part: F.col("cell").cast("long") * 2**20 + part
        vectors = held.select(key(F.pmod(F.xxhash64("id"), F.col("parts"))).alias("key"), "id", "v")
        return _met(vectors, asked_at.select(key(F.col("part")).alias("key"), "query_id", "v"), k, "cosine", least, self_pairs)
