"""Embedding whitening by LOBPCG, the locally optimal block method for eigenvectors of the covariance.

The covariance itself is never formed: Spark multiplies it with a block of vectors, as a sum over centred rows. The
driver holds blocks of that height alone: iterate, residuals, previous directions. Each round asks
Spark for the products of the new residual directions, solves the small problem in the space of all three
(Rayleigh-Ritz) and goes on until the residuals, taken from a fresh product, are at the limit of doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import materialize

#: Components; further columns of the block, which speed up the last components; residuals aimed at and
#: residuals certified, relative to the largest eigenvalue; the most rounds.
COMPONENTS, GUARD, AIM, CERTIFIED, ROUNDS, SEED = 8, 8, 2e-15, 1e-11, 500, 11
#: Entries become floor(SCALE * c) + OFFSET. Entries from LARGEST on have no exact double times SCALE.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**42
#: Components whose share of the variance is below this are rounding errors of a covariance of lower rank.
NOTHING = 1e-12

_RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Centre:
    """n vectors and their sums by dimension; span: the largest difference of two entries."""

    n: int
    sums: list[int]
    span: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64-bit integers where they hold it, Python's otherwise."""
        low = [s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, low, strict=True)]
        if self.n * (self.span + 1) < 1 << 62:
            return (x - np.array(low, np.int64)) * np.int64(self.n) - np.array(rest, np.int64)
        return (x.astype(object) - np.array(low, object)) * self.n - np.array(rest, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squared(self, x: np.ndarray) -> pa.Array:
        """Sums of squared deviations, exact."""
        d = self.deviations(x)
        if d.dtype != object and len(self.sums) * (self.n * (self.span + 1)) ** 2 < 1 << 63:
            return pa.array((d * d).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
        return pa.array((d.astype(object) ** 2).sum(1).tolist(), pa.decimal128(38, 0))


@dataclass(frozen=True)
class Eigen:
    """Eigenvectors as columns, eigenvalues falling, the trace, the largest certified residual, rounds taken."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    rounds: int


def usable(vector: Column, dim: int) -> Column:
    """Of that dimension, without null, non-finite or too large components."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)), F.lit(False))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], height: int, width: int, dim: int) -> np.ndarray:
    """The sum over all rows of a matrix that `of` gives for a batch of them: summed in tasks, then by its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch, dim))
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *(pa.array(c) for c in total.T)], names=["line", *(f"c{j}" for j in range(width))])

    parts = rows.select("x").mapInArrow(run, "line int, " + ", ".join(f"c{j} double" for j in range(width)))
    out = np.zeros((height, width))
    for r in parts.groupBy("line").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(width))).collect():
        out[r["line"]] = r[1:]
    return out


def covariance_times(rows: DataFrame, centre: Centre, block: np.ndarray) -> np.ndarray:
    """The covariance of the rows (x: array of long) times a block, by one pass over centred rows."""

    def of(x: np.ndarray) -> np.ndarray:
        d = centre.centred(x)
        return d.T @ (d @ block)

    return _summed(rows, of, len(block), block.shape[1], len(block)) / centre.n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to the orthonormal columns `against`."""
    norms = np.sqrt((block**2).sum(0))
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(1.0, s.max(initial=0.0))]
    return block


def lobpcg(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, guard: int = GUARD, aim: float = AIM, certified: float = CERTIFIED, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(vectors, values, residual, rounds): the largest eigenpairs of the symmetric matrix that `times` multiplies with.

    The block has `guard` columns more than wanted. It ends when all wanted residuals are at `aim` times the largest
    eigenvalue, or fall no more below `certified`; residuals are then taken from a fresh product, and
    if that disagrees the rounds go on from it. Residuals that stay above `certified` raise ArithmeticError.
    """
    wanted = min(wanted, dim)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, min(dim, wanted + guard))))[0]
    ax = times(x)
    p = ap = np.zeros((dim, 0))
    best, since, fresh = np.inf, 0, True
    for k in range(1, rounds + 1):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        rest = ax - x * values
        scale = max(abs(values[0]), np.finfo(float).tiny)
        worst = float(np.sqrt((rest[:, :wanted] ** 2).sum(0)).max() / scale)
        since = 0 if worst < 0.5 * best else since + 1
        best = min(best, worst)
        ended = worst <= aim or (worst <= certified and since >= 3)
        w = np.zeros((dim, 0)) if ended else _orthonormal(rest, np.hstack([x, p]))
        if ended or not w.shape[1]:
            if fresh and worst <= certified:
                return x[:, :wanted], values[:wanted], worst, k
            x = np.linalg.qr(x)[0]
            ax, fresh, p, ap = times(x), True, np.zeros((dim, 0)), np.zeros((dim, 0))
            best, since = np.inf, 2
            continue
        basis, image = np.hstack([x, w, p]), np.hstack([ax, times(w), ap])
        small = basis.T @ image
        coefficients = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, : x.shape[1]]
        # What the new iterate has from residuals and previous directions is the next direction; orthogonal to the iterate.
        onward = coefficients.copy()
        onward[: x.shape[1]] = 0
        onward = _orthonormal(onward, coefficients)
        x, ax, p, ap, fresh = basis @ coefficients, image @ coefficients, basis @ onward, image @ onward, False
    raise ArithmeticError(f"residuals of {best:.1e} after {rounds} rounds")


def principal(rows: DataFrame, centre: Centre, wanted: int = COMPONENTS, **limits) -> Eigen:
    """The first eigenvectors of the covariance of rows (x: array of long); each one's largest entry is positive."""
    dim = len(centre.sums)
    trace = float(_summed(rows, lambda x: (centre.centred(x) ** 2).sum().reshape(1, 1), 1, 1, dim)[0, 0]) / centre.n
    if trace == 0:
        return Eigen(np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0, 0)
    vectors, values, residual, rounds = lobpcg(lambda block: covariance_times(rows, centre, block), dim, wanted, **limits)
    some = values > NOTHING * trace
    vectors, values = vectors[:, some], values[some]
    top = np.abs(vectors).argmax(0)
    return Eigen(vectors * np.sign(vectors[top, np.arange(len(values))]), values, trace, residual, rounds)


def whiten(vectors: DataFrame, components: int = COMPONENTS, **limits) -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    Every entry c of a vector counts as the integer x = floor(1024 * c) + 100000. Whitened: the centred x on the
    component, over the root of its variance. Deviation: sum over dimensions of (n * x - sum)^2, exact, n being how many
    vectors there are. Explained: the component's share of the variance. Identity_error: the largest entry of the whitened columns'
    covariance less the identity, measured by one more pass.

    Vectors that are null, of another dimension than most (ties: the smaller), or hold null, non-finite or larger components than 2^42
    take no part; what remains, repeated rows and null ids included, gives a row for each component. Components
    without variance are left out: of equal vectors, one vector or an empty table nothing remains. Eigenvectors of tied eigenvalues are any of
    their space. Other columns than vec_id and embedding are not read.

    Vectors are written once as integers; each round reads them in one pass that shuffles a block of dimension times
    block width per task. Nothing that grows with the rows comes to the driver.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    top = own.where("size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not top:
        return spark.createDataFrame([], _RESULT)
    dim = top[0]["dim"]
    ints = own.where(usable(F.col("embedding"), dim)).select("vec_id", F.transform("embedding", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(OFFSET)).alias("x"))
    rows = materialize(ints, "vectors")
    found = rows.agg(F.count("*").alias("n"), F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low"), *(F.sum(F.col("x")[j].cast("decimal(20,0)")).alias(f"s{j}") for j in range(dim))).first()
    if not found["n"]:
        return spark.createDataFrame([], _RESULT)
    centre = Centre(found["n"], [int(found[f"s{j}"]) for j in range(dim)], found["high"] - found["low"])
    eigen = principal(rows, centre, components, **limits)
    k = len(eigen.values)
    if not k:
        return spark.createDataFrame([], _RESULT)
    onto = eigen.vectors / np.sqrt(eigen.values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = centre.centred(x) @ onto
        return np.vstack([y.T @ y, y.sum(0)])

    sums = _summed(rows, moments, k + 1, k, dim) / centre.n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    shares = eigen.values / eigen.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x = batch.num_rows, _matrix(batch, dim)
            row = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, centre.n)), centre.squared(x).take(row),
                    pa.array((centre.centred(x) @ onto).ravel()), pa.array(np.tile(shares, n)), pa.array(np.full(n * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, _RESULT)
