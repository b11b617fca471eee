"""Embedding compression: projections, product quantisation and the choice between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V


def technique(v: Column) -> Column:
    """The compression that a vector's size, sparsity, entropy and variance call for."""
    return (
        F.when(F.size(v) <= 128, "quantize8").when(V.sparsity(v) > 0.7, "product_quantization").when(V.entropy(v) < 0.3, "pca")
        .when(V.variance(v) > 0.1, "distillation").otherwise("adaptive")
    )


def prefix_projection(df: DataFrame, most: int = 192) -> DataFrame:
    """Adds dims, explained and p: the first 95 % of a vector's places, ``most`` at most."""
    dims = F.least(F.lit(most), F.floor(F.size("v") * 0.95).cast("int"))
    return df.withColumns({"dims": dims, "explained": dims / F.size("v"), "p": F.slice("v", F.lit(1), dims)})


def pca(df: DataFrame, dims: int) -> DataFrame:
    """Adds p, the first principal components; a component's largest weight is positive.

    One pass adds up first and second moments by partition (one row each), the
    eigenvectors are found on the driver.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, None, None
        for batch in batches:
            if len(batch):
                x = np.array(batch["v"].tolist(), float)
                n, s, ss = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if ss is None else ss + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    parts = df.select("v").mapInPandas(moments, "n long, s array<double>, ss array<double>").collect()
    if not parts:
        return df.withColumn("p", F.array().cast("array<double>"))
    n = sum(r.n for r in parts)
    mean = np.sum([r.s for r in parts], axis=0) / n
    covariance = np.sum([r.ss for r in parts], axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)
    _, vectors = np.linalg.eigh(covariance)
    basis = vectors[:, ::-1][:, :dims]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(dims)])
    return projected(df, (basis.T, mean))


def random_projection(df: DataFrame, dims: int, seed: int) -> DataFrame:
    """Adds p: a projection on seeded Gaussian directions."""
    size = df.select(F.size("v")).first()
    basis = np.random.default_rng(seed).normal(size=(dims, size[0] if size else 0)) / np.sqrt(dims)
    return projected(df, (basis, np.zeros(basis.shape[1])))


def projected(df: DataFrame, basis: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(basis)

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        rows, mean = shared.value
        return pd.Series(list((np.array(v.tolist(), float) - mean) @ rows.T)) if len(v) else pd.Series([], dtype=object)

    return df.withColumn("p", project("v"))


def codebooks(df: DataFrame, parts: int, centres: int, rounds: int = 10, sample: int = 4096, seed: int = 5) -> np.ndarray:
    """(parts, centres, width): centres of each part, by Lloyd's algorithm over a bounded sample (least hashes of the id)."""
    rows = df.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select("v").collect()
    x = np.array([r[0] for r in rows], float).reshape(len(rows), parts, -1)
    rng, out = np.random.default_rng(seed), []
    for j in range(parts):
        sub = x[:, j]
        c = sub[rng.choice(len(sub), min(centres, len(sub)), replace=False)]
        for _ in range(rounds):
            at = ((sub[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([sub[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
        out.append(c)
    return np.array(out)


def product_quantised(df: DataFrame, parts: int = 8, centres: int = 256) -> DataFrame:
    """Adds codes: for each part of the vector its nearest centre."""
    shared = df.sparkSession.sparkContext.broadcast(codebooks(df, parts, centres))

    @F.pandas_udf("array<int>")
    def coded(v: pd.Series) -> pd.Series:
        books = shared.value
        x = np.array(v.tolist(), float).reshape(len(v), len(books), -1)
        return pd.Series(list(np.stack([((x[:, j, None] - c[None]) ** 2).sum(2).argmin(1) for j, c in enumerate(books)], axis=1).astype(np.int32)))

    return df.withColumn("codes", coded("v"))


def savings(df: DataFrame, dims: int, bits: int) -> DataFrame:
    """Bytes of 32-bit vectors before and after quantisation (8 bytes for scale and zero), the ratio and the speed-up."""
    before, after = dims * 4, dims * bits // 8 + 8
    return df.agg(F.count("*").alias("n")).select(
        F.lit(f"quantize{bits}").alias("technique"), F.lit(before).alias("bytes_before"), F.lit(after).alias("bytes_after"),
        F.lit(round(before / after, 9)).alias("ratio"), F.lit(round((before / after) ** 0.5, 9)).alias("speedup"), "n",
        (F.col("n") * (before - after)).alias("saved"),
    )


def energy_projection(df: DataFrame, dims: int, least: float = 0.95) -> DataFrame:
    """Adds p, explained and dims: the first places as far as they hold ``least`` of the energy, else the whole vector."""
    part = F.slice("v", 1, dims)
    share = F.coalesce(F.try_divide(V.dot(part, part), V.dot(F.col("v"), F.col("v"))), F.lit(0.0))
    out = df.withColumn("_share", share)
    enough = F.col("_share") >= least
    return out.withColumns(
        {"p": F.when(enough, part).otherwise(F.col("v")), "explained": F.when(enough, F.col("_share")).otherwise(1.0), "dims": F.when(enough, F.lit(dims)).otherwise(F.size("v"))}
    ).drop("_share")


def quality_controlled(df: DataFrame, most_error: float, bits: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    """Adds ``bits`` and ``error``: the fewest bits whose mean error stays within bounds, else the most bits."""
    tried = [F.struct(F.lit(b).alias("bits"), V.mean(F.zip_with("v", V.restored(V.quantised(F.col("v"), b)), lambda x, y: F.abs(x - y))).alias("error")) for b in bits]
    out = df.withColumn("_t", F.array(*tried))
    fit = F.get(F.filter("_t", lambda t: t["error"] <= most_error), F.lit(0))
    return out.withColumn("_f", F.coalesce(fit, F.element_at("_t", -1))).withColumns({"bits": F.col("_f.bits"), "error": F.col("_f.error")}).drop("_t", "_f")


# What techniques do to the estimated drop in accuracy.
DROP = {"distillation": 0.8, "product_quantization": 1.2, "quantize4": 1.5}


def accuracy_drop(error: Column, explained: Column, name: Column) -> Column:
    """Ten times the mean error, weighted by the technique, and half of the variance that is not explained; 0 to 1."""
    weight = F.lit(1.0)
    for k, w in DROP.items():
        weight = F.when(name == k, w).otherwise(weight)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), error * 10 * weight + (1 - explained) * 0.5))


def _mean_error(v: Column, r: Column) -> Column:
    return F.coalesce(V.mean(F.zip_with(v, r, lambda x, y: F.abs(x - y))), F.lit(0.0))


def compressed(df: DataFrame, most: int = 192, most_drop: float = 0.05, seed: int = 11) -> DataFrame:
    """Compresses each v by the technique in the column ``name`` (null: by ``technique``).

    Adds technique, codes, scale, zero, bytes_before, bytes_after, ratio,
    explained, error, drop and speedup. ``adaptive`` takes the first of
    quantize8, pca and product_quantization whose drop is within ``most_drop``.
    A product code of a single vector has the vector as its only centre and
    restores it exactly (product_quantised shares codebooks); a distilled
    vector is a seeded projection and cannot be restored. Empty or null
    vectors, and unknown names, stay as they are (technique ``none``).
    """
    v, size = F.col("v"), F.size("v")
    dims = F.least(F.lit(most), F.floor(size * 0.95).cast("int"))
    named = df.withColumns({"_q8": V.quantised(v, 8), "_q4": V.quantised(v, 4), "_n": F.coalesce("name", technique(v))})
    kept = dims / F.nullif(size, F.lit(0))
    drop8 = accuracy_drop(_mean_error(v, V.restored(F.col("_q8"))), F.lit(1.0), F.lit("quantize8"))
    chosen = F.when(drop8 <= most_drop, "quantize8").when((1 - kept) * 0.5 <= most_drop, "pca").otherwise("product_quantization")
    known = F.col("_n").isin("quantize8", "quantize4", "pca", "distillation", "product_quantization", "adaptive")
    named = named.withColumn("technique", F.when(~F.coalesce(size > 0, F.lit(False)) | ~known, "none").when(F.col("_n") == "adaptive", chosen).otherwise(F.col("_n")))
    t = F.col("technique")

    @F.pandas_udf("array<double>")
    def distilled(x: pd.Series) -> pd.Series:
        bases: dict[int, np.ndarray] = {}

        def one(values):
            if values is None:
                return None
            n = len(values)
            if n not in bases:
                bases[n] = np.random.default_rng(seed).uniform(-1, 1, (most, n)) * np.sqrt(n / most)
            return bases[n] @ np.asarray(values, float)

        return pd.Series([one(values) for values in x], dtype=object)

    wide = lambda q: F.transform(q["codes"], lambda c: c.cast("double"))
    codes = (
        F.when(t == "quantize8", wide(F.col("_q8"))).when(t == "quantize4", wide(F.col("_q4"))).when(t == "pca", F.slice("v", F.lit(1), dims))
        .when(t == "distillation", F.col("_d")).otherwise(v)
    )
    part = lambda field: F.when(t == "quantize8", F.col("_q8")[field]).when(t == "quantize4", F.col("_q4")[field])
    error = F.when(t == "quantize8", _mean_error(v, V.restored(F.col("_q8")))).when(t == "quantize4", _mean_error(v, V.restored(F.col("_q4")))).otherwise(0.0)
    out = named.withColumn("_d", distilled(F.when(t == "distillation", v)))
    out = out.withColumns({"codes": codes, "scale": part("scale"), "zero": part("zero"), "explained": F.when(t == "pca", kept).otherwise(1.0), "error": error, "bytes_before": size * 4})
    out = out.withColumn("bytes_after", F.when(t.isin("quantize8", "quantize4"), size).otherwise(F.size("codes") * 4))
    ratio = F.coalesce(F.try_divide("bytes_before", "bytes_after"), F.lit(1.0))
    return out.withColumns({"ratio": ratio, "drop": accuracy_drop(F.col("error"), F.col("explained"), t), "speedup": F.sqrt(ratio)}).drop("_q8", "_q4", "_n", "_d")


def decompressed(df: DataFrame) -> DataFrame:
    """Adds ``restored`` to the rows of ``compressed``: codes scaled back, a prefix filled up with zeros, null for distilled vectors."""
    codes, t = F.col("codes"), F.col("technique")
    scaled = F.transform(codes, lambda c: (c - F.col("zero")) * F.col("scale"))
    filled = F.concat(codes, F.array_repeat(F.lit(0.0), (F.col("bytes_before") / 4).cast("int") - F.size(codes)))
    return df.withColumn("restored", F.when(t.isin("quantize8", "quantize4"), scaled).when(t == "pca", filled).when(t != "distillation", codes))
