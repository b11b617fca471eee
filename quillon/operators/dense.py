"""Dense retrieval: exact top-k by similarity (``knn``, see ``vector_index``), means, clustering. Vectors are (id, v) with v an array of doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.vector_index import exact as knn  # noqa: F401

def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def vector_mean(df: DataFrame, by: list[str]) -> DataFrame:
    """(*by, mean): the element-wise mean of v; partial sums are formed before the shuffle."""
    cells = df.select(*by, F.posexplode(V.doubles(F.col("v"))).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("mean"))


def kmeans(df: DataFrame, k: int, rounds: int = 100, within: float = 1e-4) -> DataFrame:
    """(id, cluster): Lloyd's algorithm from the first k vectors by id; ties go to the lowest cluster.

    The k centres are on the driver; a round sends one partial sum for each
    cluster and partition.
    """
    spark = df.sparkSession
    data = df.select(F.col("id").cast("long"), V.doubles(F.col("v")).alias("v"))
    centres = np.array([r[0] for r in data.orderBy("id").limit(k).select("v").collect()], float)

    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin(((x[:, None, :] - c[None, :, :]) ** 2).sum(2), axis=1)

    def sums(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                for first in range(0, len(batch), 2048):
                    x = _matrix(batch["v"].iloc[first : first + 2048])
                    at = nearest(x, c)
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(c))
            yield pd.DataFrame({"cluster": range(len(c)), "n": n, "total": list(total)})

        return run

    for _ in range(rounds if len(centres) else 0):
        shared = spark.sparkContext.broadcast(centres)
        parts = data.mapInPandas(sums(shared), "cluster long, n long, total array<double>").collect()  # k rows a partition
        new = centres.copy()
        for j in range(len(centres)):
            n = sum(r.n for r in parts if r.cluster == j)
            if n:
                new[j] = np.sum([r.total for r in parts if r.cluster == j], axis=0) / n
        moved = np.sqrt(((new - centres) ** 2).sum(1)).max()
        centres = new
        if moved < within:
            break
    shared = spark.sparkContext.broadcast(centres)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "cluster": nearest(_matrix(batch["v"]), shared.value)})

    return data.mapInPandas(assigned, "id long, cluster long")
