"""Whitening of embeddings by a locally optimal block preconditioned conjugate gradient method (LOBPCG).

Vectors become whole numbers x, floor(scale * c) + shift. The covariance is that of the different x vectors (the fit list), which is
written to the shared folder once. It is never formed: an iteration is one pass over the fit list, in which every
task centres its rows (n * x - S is exact in whole numbers) and adds Y'(YQ) for the block Q that spans the present
iterate, its residuals and its previous direction; a shuffle on the dimension adds the tasks' products, and the driver gets
a matrix of dimensions by block width. Rayleigh-Ritz on Q gives the next iterate. It ends when the residuals of all
wanted components, which come from the pass itself, are certified below `tolerance` times the largest eigenvalue, or no longer fall; a fit
whose residuals stay above `accept` raises an error. Then one more pass takes the whitened covariance, and all rows are projected.

What the driver holds is bounded by the dimension (a few matrices of dimensions by block width), never by the rows.

Edge cases: vectors that are null or hold null or non-finite entries give no rows; an id may be null or repeated; vectors of each length
are a fit of their own; a component has a positive eigenvalue (more than `rank` times the largest), so an empty vector, or a fit
list of one vector, gives no rows; entries beyond +-10**12 after scaling are held there; an empty table gives an empty
result; other columns are ignored. Equal eigenvalues: any orthonormal vectors of their space, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, written

SCALE, SHIFT, LIMIT = 64, 1_000_000, 10**12
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x) of the vectors without null and non-finite entries; x is an array of longs."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))).cast("long")
    return rows.filter(v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: held(c) + F.lit(shift)).alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


@dataclass
class Moments:
    """Of the fit list: dimensions, rows, sums by dimension (exact)."""

    dim: int
    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where nothing can leave their range, else Python's integers."""
        most = max(map(abs, self.sums), default=0) + self.n * (int(np.abs(x).max(initial=0)) + 1)
        if most < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)


def summed(table: DataFrame, dim: int, work: Callable[[np.ndarray], tuple[np.ndarray, float]], height: int, width: int) -> tuple[np.ndarray, float]:
    """The sum over the fit list of work(vectors) = (matrix of height x width, number): by task first, then by row of the matrix."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, more = np.zeros((height, width)), 0.0
        for b in batches:
            if len(b):
                own, number = work(matrix(b.column(0), dim))
                total, more = total + own, more + number
        i, j = np.append(np.repeat(np.arange(height), width), height), np.append(np.tile(np.arange(width), height), 0)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.append(total.ravel(), more))], names=["i", "j", "v"])

    parts = table.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (parts.column(c).to_numpy() for c in "ijv")
    out = np.zeros((height + 1, width))
    out[i, j] = v
    return out[:height], float(out[height, 0])


def moments(vectors: DataFrame, dim: int) -> tuple[DataFrame, Moments]:
    """The different vectors of a length as a table of the shared folder, their number and their exact sums."""
    table = written(vectors.select("x").distinct(), "fit")
    one = table.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    rows = one.collect()  # a row a dimension
    sums = [0] * dim
    for r in rows:
        sums[r["i"]] = int(r["s"])
    return table, Moments(dim, rows[0]["n"] if rows else 0, sums)


def product(table: DataFrame, fit: Moments, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(V Q, trace of V): one pass over the fit list, centred before multiplying."""

    def work(x: np.ndarray) -> tuple[np.ndarray, float]:
        y = fit.centred(x)
        return y.T @ (y @ q), float((y * y).sum())

    total, square = summed(table, fit.dim, work, fit.dim, q.shape[1])
    return total / fit.n, square / fit.n


@dataclass
class Components:
    """Eigenvalues in falling order with unit eigenvectors (as columns), the covariance's trace, certified residuals, passes taken."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def orthonormal(blocks: list[np.ndarray], least: float = 1e-12) -> np.ndarray:
    """A basis of the blocks' columns, earlier blocks first; what earlier columns nearly hold is left out."""
    out = blocks[0][:, :0]
    for block in blocks:
        for _ in range(2):  # twice is enough
            block = block - out @ (out.T @ block)
            size = np.linalg.norm(block, axis=0)
            block = block[:, size > least] / size[size > least]
            if block.shape[1]:
                u, s, _ = np.linalg.svd(block, full_matrices=False)
                block = u[:, s > 1e-8 * s[0]]
        out = np.hstack([out, block - out @ (out.T @ block)])
    return np.linalg.qr(out)[0]


def lobpcg(apply: Callable[[np.ndarray], tuple[np.ndarray, float]], dim: int, k: int, guard: int | None = None, tolerance: float = 1e-14, accept: float = 1e-9, most: int = 500, seed: int = 7) -> Components:
    """The k largest eigenpairs of a symmetric operator that is known by its products with blocks.

    guard: further columns of the iterate, so that the last wanted component has company; seed: of the first iterate.
    """
    k = min(k, dim)
    width = min(dim, k + (max(8, k // 2) if guard is None else guard))
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    residual = previous = np.zeros((dim, 0))
    best, stale = None, 0
    for passes in range(1, most + 1):
        q = orthonormal([x, residual, previous])
        image, trace = apply(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1][:, :width]
        values = values[::-1][:width]
        new = q @ turn
        left = image @ turn - new * values
        error = np.linalg.norm(left[:, :k], axis=0)
        if best is None or error.max(initial=0) < 0.5 * best.residuals.max(initial=0):
            best, stale = Components(values[:k], new[:, :k], trace, error, passes), 0
        else:
            stale += 1
        best.passes = passes
        if error.max(initial=0) <= tolerance * max(values[0], 0.0) or q.shape[1] == dim and passes > 2 or stale >= 20 and best.residuals.max() <= accept * values[0]:
            break
        previous = new - x @ (x.T @ new)  # what moved out of the last iterate
        x, residual = new, left
    if best.residuals.max(initial=0) > accept * max(best.values[0], 0.0):
        raise ValueError(f"residuals of {best.residuals.max():.3g} after {best.passes} passes: the spectrum needs a larger guard or more passes")
    return best


def fit_components(vectors: DataFrame, dim: int, k: int = 16, rank: float = 1e-10, **options: float) -> tuple[Moments, Components, float]:
    """(moments, components, identity error) of the vectors of one length; components of no variance are left out."""
    table, fit = moments(vectors, dim)
    found = lobpcg(lambda q: product(table, fit, q), dim, k, **options) if dim and fit.n > 1 else Components(np.zeros(0), np.zeros((dim, 0)), 0.0, np.zeros(0), 0)
    keep = found.values > rank * max(found.values.max(initial=0), 0.0)
    found = Components(found.values[keep], found.vectors[:, keep], found.trace, found.residuals[keep], found.passes)
    m = len(found.values)
    if not m:
        return fit, found, 0.0
    basis = found.vectors / np.sqrt(found.values)

    def squares(x: np.ndarray) -> tuple[np.ndarray, float]:
        z = fit.centred(x) @ basis
        return np.vstack([z.T @ z, z.sum(0)]), 0.0

    total, _ = summed(table, dim, squares, m + 1, m)
    mean = total[m] / fit.n
    return fit, found, float(np.abs(total[:m] / fit.n - np.outer(mean, mean) - np.eye(m)).max())


def whiten(rows: DataFrame, k: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT, **options: float) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each sound row and component up to k.

    options: those of lobpcg.
    """
    vectors = whole_vectors(small_batches(rows), id_col, vector_col, scale, shift)
    lengths = [r[0] for r in vectors.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]  # one for all, as a rule
    parts = []
    for dim in lengths:
        own = vectors.filter(F.size("x") == dim)
        fit, found, error = fit_components(own, dim, k, **options)
        if len(found.values):
            parts.append(_projected(own, fit, found, error))
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], OUT)


def _projected(vectors: DataFrame, fit: Moments, found: Components, error: float) -> DataFrame:
    basis, dim = found.vectors / np.sqrt(found.values), fit.dim

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), dim)
            y = fit.deviations(x)
            if y.dtype == object or int(np.abs(y).max(initial=0)) ** 2 * dim >= 2**63:
                whole = [sum(int(c) ** 2 for c in row) for row in y.tolist()]
                square = pa.array([Decimal(s) if s < 10**38 else None for s in whole], pa.decimal128(38, 0))
            else:
                square = pa.array((y * y).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
            z = (y / fit.n).astype(float) @ basis
            where = pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), square, pa.ListArray.from_arrays(where, pa.array(z.ravel()))], names=["vec_id", "deviation", "z"])

    share = F.array(*(F.lit(float(v / found.trace)) for v in found.values))
    projected = vectors.mapInArrow(work, "vec_id long, deviation decimal(38,0), z array<double>").select("vec_id", "deviation", F.posexplode("z").alias("i", "whitened"))
    return projected.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"))
