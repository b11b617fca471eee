"""Whitening of embeddings by their leading components, found by a matrix-free block Lanczos method.

Method. The covariance is never formed. A pass over the vectors multiplies it
with a block of b vectors: each task centres its rows, forms ``Xᵀ(XQ)`` and sends
one matrix of dimensions times b. The driver holds what a small basis needs (dimensions
times ``BASIS`` numbers) and nothing that grows with the rows:

* Block Krylov basis: what a pass gives is made orthogonal against the whole
  basis, twice (full reorthogonalisation), and becomes the next block.
* Breakdown: directions that vanish in this are replaced by random ones (of a
  fixed seed) orthogonal to the basis, so that the block stays whole; the
  search starts again from them in the part that the basis does not reach.
* Ritz pairs come from the basis and its products; the residuals need no pass of
  their own. The search ends when all wanted residuals are at rounding level, or
  the basis spans the space, where the pairs are exact to rounding.
* A full basis is cut to its best pairs and the last block of residuals, and goes on
  (thick restart), up to ``RESTARTS`` times or until restarts gain nothing.

Entries are whole numbers x = floor(1024 c) + 100000, so that sums, and each
row's deviation from the mean, are exact. ``trace`` is the sum of the deviations;
it gives the components' shares without the other eigenvalues.

Partial sums of tasks are added in a fixed order in ``FAN`` groups first, so that
the driver gets ``FAN`` rows a pass whatever the number of tasks.

Cases: rows whose vector is null or has null or non-finite entries are dropped
first; shorter vectors (an empty one too) count as padded by zeros to the longest;
entries of more than 2^40 in magnitude count as 2^40; a deviation beyond 2^63 is null in
``deviation`` and whole in ``deviation_exact``; components without variance (up to
rounding) are left out, so that equal rows or a single one give no rows, as an
empty table does; repeated rows, null ids and long tables are nothing special;
other columns are not read. Equal eigenvalues leave the choice of their components open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import read_table

#: Components wanted, and vectors of a block.
COMPONENTS, BLOCK = 8, 8
#: Vectors of a basis at most before it restarts, and restarts at most.
BASIS, RESTARTS = 128, 50
#: Groups that the tasks' sums are added in, and rows that a task centres at once.
FAN, ROWS = 16, 4096
OFFSET, FACTOR, MOST = 100_000, 1024, 2**40


def entries(lists: pa.Array, d: int) -> np.ndarray:
    """A batch's vectors as rows of whole numbers, padded to d."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    whole = np.floor(np.clip(values, -MOST, MOST) * FACTOR).astype(np.int64) + OFFSET
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if len(sizes) * d == len(whole) and (sizes == d).all():
        return whole.reshape(-1, d)
    out = np.full((len(sizes), d), OFFSET, np.int64)
    out[np.arange(d) < sizes[:, None]] = whole
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, rounded once: by whole numbers as long as they fit, else by floats of the exact difference from the rounded mean."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row the sum of (n x - S)^2, exact."""
    apart = [x[:, j].astype(object) * n - s for j, s in enumerate(sums)] if _large(x, n, sums) else None
    if apart is not None:
        return [int(sum(c[i] * c[i] for c in apart)) for i in range(len(x))]
    y = x * n - np.array(sums, np.int64)
    return (y * y).sum(1).tolist()


def _large(x: np.ndarray, n: int, sums: list[int]) -> bool:
    """Whether (n x - S)^2, summed, or n x itself could leave 63 bits."""
    if not len(x):
        return False
    most = max(int(np.abs(x).max()) * n, max(map(abs, sums), default=0))
    apart = max(max(int(hi) * n - s, s - int(lo) * n) for hi, lo, s in zip(x.max(0), x.min(0), sums, strict=True))
    return most >= 2**62 or apart * apart * len(sums) >= 2**63


def _rows(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            yield part, entries(part["vector"], d)


def _added(df: DataFrame, run: Callable, kind: str, merge: Callable) -> list:
    """What each task sends, merged in FAN groups by a fixed order, and the groups' rows."""
    parts = df.mapInArrow(run, kind).withColumn("_part", F.spark_partition_id()).withColumn("_fan", F.col("_part") % FAN)

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("_part")
        return pa.Table.from_pylist([merge(table.to_pylist())], schema=schema)

    names = [c for c in parts.columns if not c.startswith("_")]
    schema = pa.schema(_schema(parts.select(*names)))
    found = parts.groupBy("_fan").applyInArrow(lambda key, table: group(table).append_column("_fan", pa.array([key[0].as_py()], pa.int32())), kind + ", _fan int")
    return [r.asDict() for r in found.orderBy("_fan").collect()]  # FAN rows


def _schema(df: DataFrame) -> list[pa.Field]:
    kinds = {"bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "string": pa.string(), "int": pa.int32()}
    return [pa.field(name, kinds[kind]) for name, kind in df.dtypes]


class Fit:
    """Number of rows, exact sums and the leading components of a table's vectors."""

    def __init__(self, n: int, d: int, sums: list[int]):
        self.n, self.d, self.sums = n, d, sums
        self.trace = 0.0
        self.values, self.components = np.zeros(0), np.zeros((d, 0))
        self.passes, self.residuals = 0, np.zeros(0)


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, vector) without vectors that are null or hold null or non-finite entries."""
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.filter(F.col("vector").isNotNull() & finite)


def _moments(df: DataFrame) -> Fit:
    """Rows, dimensions and sums, in one pass."""
    d = df.agg(F.max(F.size("vector"))).first()[0] or 0
    if not d:
        return Fit(0, 0, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for _, x in _rows(batches, d):
            n += len(x)
            sums = [a + b for a, b in zip(sums, x.sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(s) for s in sums]]})

    def merge(rows: list[dict]) -> dict:
        return {"n": sum(r["n"] for r in rows), "sums": [str(sum(map(int, c))) for c in zip(*(r["sums"] for r in rows), strict=True)]}

    total = merge(_added(df, run, "n long, sums array<string>", merge) or [{"n": 0, "sums": ["0"] * d}])
    return Fit(total["n"], d, [int(s) for s in total["sums"]])


def _sum_rows(rows: list[dict]) -> dict:
    return {"deviation": str(sum(int(r["deviation"]) for r in rows)), "product": np.sum([r["product"] for r in rows], axis=0).tolist()}


def _product(df: DataFrame, fit: Fit, q: np.ndarray, with_trace: bool) -> np.ndarray:
    """Covariance times q, by one pass; the first pass adds up the deviations as well."""
    n, d, sums, b = fit.n, fit.d, fit.sums, q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, deviation = np.zeros((d, b)), 0
        for _, x in _rows(batches, d):
            y = centred(x, n, sums)
            total += y.T @ (y @ q)
            if with_trace:
                deviation += sum(deviations(x, n, sums))
        yield pa.RecordBatch.from_pydict({"deviation": [str(deviation)], "product": [total.ravel().tolist()]})

    total = _sum_rows(_added(df, run, "deviation string, product array<double>", _sum_rows))
    fit.passes += 1
    if with_trace:
        fit.trace = int(total["deviation"]) / n**3
    return np.array(total["product"]).reshape(d, b) / n


def orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, lost: float) -> np.ndarray:
    """The block made orthonormal, and orthogonal to the basis; what falls under ``lost`` is replaced by random directions, while there are any."""
    d, out = block.shape[0], []
    for column in block.T:
        for attempt in range(6):
            if basis.shape[1] + len(out) >= d:
                break
            against = np.column_stack([basis, *out]) if out else basis
            v, limit = (column, lost) if not attempt else (rng.standard_normal(d), 1e-3)
            v = v - against @ (against.T @ v)
            size = np.linalg.norm(v)
            if size <= limit:
                continue
            v = v / size
            v = v - against @ (against.T @ v)  # once more: the first time leaves rounding of the parts taken out
            again = np.linalg.norm(v)
            if again < 0.5:
                continue
            v = v / again
            out.append(v - against @ (against.T @ v))
            out[-1] /= np.linalg.norm(out[-1])
            break
    return np.column_stack(out) if out else np.zeros((d, 0))


def lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int, most: int = BASIS, restarts: int = RESTARTS, seed: int = 13):
    """(values, vectors, residuals): the greatest eigenpairs of a symmetric operator, which ``product`` multiplies with blocks."""
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    most = max(most, 3 * max(wanted, block))
    fresh = orthogonal(rng.standard_normal((d, min(block, d))), basis, rng, 1e-3)
    best, stalls = np.inf, 0
    while True:
        image = product(fresh)
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, image])
        small = basis.T @ images
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        k = min(wanted, len(values))
        vectors = basis @ turned[:, :k]
        remains = images @ turned[:, :k] - vectors * values[:k]
        residuals = np.linalg.norm(remains, axis=0)
        scale = max(abs(values[0]), np.finfo(float).tiny)
        whole = basis.shape[1] >= d
        if whole or (basis.shape[1] > wanted and residuals.max() <= 16 * np.finfo(float).eps * scale):
            break
        if basis.shape[1] + block > most:
            # the last residuals span the next block; the best pairs stay, and so do their products
            stalls = stalls + 1 if residuals.max() > best / 2 else 0
            best = min(best, residuals.max())
            restarts -= 1
            if restarts < 0 or stalls >= 3:
                break
            held = min(most // 2, max(2 * wanted, block))
            turn = turned[:, :held]
            left = image - basis @ (basis.T @ image)
            basis, images = basis @ turn, images @ turn
            fresh = orthogonal(left, basis, rng, 1e-12 * scale)
            continue
        fresh = orthogonal(image, basis, rng, 1e-12 * scale)
    return values[:k], vectors / np.linalg.norm(vectors, axis=0), residuals


def fitted(df: DataFrame, components: int = COMPONENTS, block: int = BLOCK, most: int = BASIS) -> Fit:
    """Fits (vec_id, vector), which ``usable`` has cleared."""
    fit = _moments(df)
    if not fit.n or not fit.d:
        return fit
    values, vectors, residuals = lanczos(lambda q: _product(df, fit, q, not fit.passes), fit.d, min(components, fit.d), min(block, fit.d), most)
    kept = values > 1e-12 * fit.trace if fit.trace > 0 else np.zeros(len(values), bool)
    fit.values, fit.components, fit.residuals = values[kept], vectors[:, kept], residuals[kept]
    return fit


def _identity_error(df: DataFrame, fit: Fit) -> float:
    """The whitened rows' covariance against the identity, by one pass; sums over centred entries are exactly centred up to rounding."""
    n, d, sums, k, scaled = fit.n, fit.d, fit.sums, len(fit.values), fit.components / np.sqrt(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _rows(batches, d):
            w = centred(x, n, sums) @ scaled
            total += w.T @ w
        yield pa.RecordBatch.from_pydict({"deviation": ["0"], "product": [total.ravel().tolist()]})

    total = _sum_rows(_added(df, run, "deviation string, product array<double>", _sum_rows))
    return float(np.abs(np.array(total["product"]).reshape(k, k) / n - np.eye(k)).max())


def whitened(df: DataFrame, components: int = COMPONENTS, block: int = BLOCK, most: int = BASIS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of (vec_id, vector): a row for each vector and component."""
    rows = usable(df.select("vec_id", "vector"))
    fit = fitted(rows, components, block, most)
    n, d, sums, k = fit.n, fit.d, fit.sums, len(fit.values)
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    if not k:
        return df.sparkSession.createDataFrame([], kind)
    scaled, shares, error = fit.components / np.sqrt(fit.values), fit.values / fit.trace, _identity_error(rows, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _rows(batches, d):
            w, exact = centred(x, n, sums) @ scaled, deviations(x, n, sums)
            m = len(x)
            fits = [v if v < 2**63 else None for v in exact]
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": part["vec_id"].take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, n, np.int64)), "deviation": pa.array(fits, pa.int64()).take(each), "whitened": pa.array(w.ravel()),
                "explained": pa.array(np.tile(shares, m)), "identity_error": pa.array(np.full(m * k, error)),
                "deviation_exact": pa.array([str(v) for v in exact], pa.string()).take(each),
            })

    return rows.mapInArrow(run, kind)


def op13_block_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
