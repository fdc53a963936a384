"""Embedding whitening with a covariance by polarisation.

Only variances are aggregated: of every dimension, and of the sum of every two. As Var(a + b) - Var(a) - Var(b) is twice
Cov(a, b), differences of variances give all cross-covariances. Vectors are integers and are centred as ``n * x - S``
(count times entry less the dimension's sum), which is an integer too, so all squares and sums are exact; the assembled
matrix goes to ``eigh``."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import columns_without, quoted, written
from webloom.session import ship_package

#: Rows worked on at once, and the bits of a limb: squares of limbs of 21 bits add up in a long for 2**20 rows.
ROWS, LIMB = 256, 21
#: Centred values must stay below this, so that a sum of two has three limbs.
LARGEST = 2 ** 61
#: Components with an eigenvalue below this share of the largest are rounding noise of a rank-deficient matrix.
RANK = 1e-13


def quantised(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """``floor(scale * c) + shift`` of every component as a long; null if the vector is null or holds a null or
    non-finite component. A component whose product is beyond a long fails in :func:`fit`."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + shift))


@dataclass(frozen=True)
class Whitening:
    """What :func:`fit` learned: ``n`` distinct vectors, exact sums by dimension, the exact numerators of the covariance
    (over ``n ** 3``), eigenvalues falling, and one unit eigenvector a row."""
    n: int
    sums: tuple[int, ...]
    numerators: tuple[tuple[int, ...], ...]
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def trace(self) -> float:
        return float(sum(self.numerators[i][i] for i in range(len(self.sums))) / self.n ** 3) if self.n else 0.0


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(dims: int):
    """Arrow map: one row a dimension and task with count, sum (as two longs), least and largest entry."""
    def run(batches):
        n, low, high = 0, np.zeros(dims, object), np.zeros(dims, object)
        least, most = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _rows(batch.column(0).slice(at, ROWS), dims)
                n += len(x)
                high = high + (x >> 32).sum(axis=0).astype(object)
                low = low + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            total = [Decimal(int(h) * 2 ** 32 + int(v)) for h, v in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(total, pa.decimal128(38, 0)),
                 pa.array(least), pa.array(most)], names=["i", "n", "s", "least", "most"])
    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray, base: np.ndarray) -> np.ndarray:
    """``n * x - S`` without leaving the range of a long: ``n * (x - base) - (S - n * base)``."""
    return n * (x - base) - (sums - n * base).astype(np.int64)


def _square_sums(values: np.ndarray) -> list[int]:
    """Exact sums of squares by column of longs below ``2 * LARGEST`` in size."""
    size = np.abs(values)
    mask = (1 << LIMB) - 1
    a, b, c = size >> (2 * LIMB), (size >> LIMB) & mask, size & mask
    parts = [(a, a, 4, 1), (a, b, 3, 2), (a, c, 2, 2), (b, b, 2, 1), (b, c, 1, 2), (c, c, 0, 1)]
    total = [0] * values.shape[1]
    for p, q, limbs, times in parts:
        if p.any():
            for k, v in enumerate(np.einsum("ij,ij->j", p, q).tolist()):
                total[k] += v * times << (limbs * LIMB)
    return total


def _variances(dims: int, n: int, sums: list[int], base: list[int]):
    """Arrow map: the sum of squared centred values of every dimension (i, i) and of every pair sum (i, j), a task."""
    left, right = np.triu_indices(dims)
    single = left == right

    def run(batches):
        s, b = np.array(sums, object), np.array(base, np.int64)
        total, seen = [0] * len(left), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _centred(_rows(batch.column(0).slice(at, ROWS), dims), n, s, b)
                seen = True
                for k in range(0, len(left), 512):
                    i, j = left[k:k + 512], right[k:k + 512]
                    pair = y[:, i] + np.where(single[k:k + 512], 0, y[:, j])
                    for m, v in enumerate(_square_sums(pair), k):
                        total[m] += v
        if seen:  # two halves, as one may not fit a decimal of 38 digits
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int32()), pa.array(right, pa.int32()),
                 pa.array([Decimal(v >> 64) for v in total], pa.decimal128(38, 0)),
                 pa.array([Decimal(v & (2 ** 64 - 1)) for v in total], pa.decimal128(38, 0))], names=["i", "j", "high", "low"])
    return run


def _projected(x: np.ndarray, n: int, sums: np.ndarray, base: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return _centred(x, n, sums, base).astype(np.float64) @ basis


def _moments(dims: int, n: int, sums: list[int], base: list[int], basis: np.ndarray):
    """Arrow map: count, means and centred products of the whitened vectors of a task."""
    def run(batches):
        s, b, k = np.array(sums, object), np.array(base, np.int64), basis.shape[1]
        count, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = _projected(_rows(batch.column(0).slice(at, ROWS), dims), n, s, b, basis)
                m = w.mean(axis=0)
                both, away = count + len(w), m - mean
                products += (w - m).T @ (w - m) + np.outer(away, away) * (count * len(w) / both)
                mean, count = mean + away * (len(w) / both), both
        if count:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(products[i, j]), pa.array(count * mean[i] * mean[j]),
                 pa.array(np.where(i == j, count * mean[i], 0.0))], names=["i", "j", "inside", "between", "total"])
    return run


def prepared(df: DataFrame, vector: str) -> DataFrame:
    """Rows of ``df`` whose ``vector`` (array<long>) is not null and has the commonest length there (at a tie the
    longest): vectors of another length have no place in the space."""
    sizes = df.where(quoted(vector).isNotNull()).groupBy(F.size(quoted(vector)).alias("d")).count()
    most = sizes.agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    return df.where(quoted(vector).isNotNull() & (F.size(quoted(vector)) == (most["d"] if most else 0)))


def fit(df: DataFrame, vector: str, components: int = 16) -> Whitening:
    """Mean, covariance and up to ``components`` eigenvectors of the distinct vectors of ``df`` (array<long>, all of one
    length, see :func:`prepared`).

    Vectors are made distinct by a partial aggregate before the shuffle, so copies cost one row a task. Each task reduces
    its vectors to one row a dimension, then one row a pair; these are added up by pair and only the matrix, whose size
    is the dimension squared, reaches the driver. Components whose eigenvalue is zero to rounding are left out: there
    is nothing to scale to 1. An empty table gives ``n = 0`` and no component. Centred values beyond ``LARGEST`` fail."""
    ship_package(df.sparkSession)
    once = written(df.select(quoted(vector).alias("x")).distinct(), "fit")
    first = once.select(F.size("x").alias("d")).first()
    dims = first["d"] if first else 0
    if not dims:
        return Whitening(once.count(), (), (), np.zeros(0), np.zeros((0, 0)), 0.0)
    rows = (once.mapInArrow(_sums(dims), "i int, n long, s decimal(38,0), least long, most long").groupBy("i")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
            .orderBy("i").collect())
    n, sums = rows[0]["n"], [int(r["s"]) for r in rows]
    base = [s // n for s in sums]
    if max(n * max(r["most"] - b + 1, b - r["least"] + 1) for r, b in zip(rows, base, strict=True)) >= LARGEST:
        raise ValueError("centred values are too large to be squared exactly")
    pairs = (once.mapInArrow(_variances(dims, n, sums, base), "i int, j int, high decimal(38,0), low decimal(38,0)")
             .groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect())
    square = {(r["i"], r["j"]): (int(r["high"]) << 64) + int(r["low"]) for r in pairs}
    # polarisation; twice the covariance is even, as (a + b)**2 - a**2 - b**2 is
    numerators = [[square[i, i] if i == j else (square[min(i, j), max(i, j)] - square[i, i] - square[j, j]) // 2
                   for j in range(dims)] for i in range(dims)]
    cov = np.array([[v / n ** 3 for v in row] for row in numerators])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = int(min(components, (values > max(values[0], 0) * RANK * dims).sum())) if values[0] > 0 else 0
    model = Whitening(n, tuple(sums), tuple(map(tuple, numerators)), values[:k].copy(), vectors[:k].copy(), 0.0)
    if not k:
        return model
    moments = (once.mapInArrow(_moments(dims, n, sums, base, _basis(model)), "i int, j int, inside double, between double, total double")
               .groupBy("i", "j").agg(F.sum("inside").alias("inside"), F.sum("between").alias("between"), F.sum("total").alias("total")).collect())
    total = {r["i"]: r["total"] for r in moments if r["i"] == r["j"]}
    error = max(abs((r["inside"] + r["between"] - total[r["i"]] * total[r["j"]] / n) / n - (r["i"] == r["j"])) for r in moments)
    return Whitening(n, model.sums, model.numerators, model.values, model.vectors, float(error))


def _basis(model: Whitening) -> np.ndarray:
    """Eigenvectors as columns, scaled so that centred integers become whitened values."""
    return (model.vectors / np.sqrt(model.values)[:, None] / model.n).T


def whiten(df: DataFrame, model: Whitening, vector: str) -> DataFrame:
    """Every row of ``df`` (of :func:`prepared`) with ``deviation decimal(38,0)``, the exact sum over dimensions of
    ``(n * x - S) ** 2``, and ``whitened array<double>``, one value a component. Input columns of these names are
    replaced, ``vector`` and all others stay. Repeated rows are rows of their own."""
    ship_package(df.sparkSession)
    kept = columns_without(df, ("deviation", "whitened"))
    src = df.select(*[quoted(c) for c in kept], quoted(vector).alias("__x"))
    out = T.StructType([src.schema[c] for c in kept] + [T.StructField("deviation", T.DecimalType(38, 0)),
                                                        T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    n, sums, dims = model.n, list(model.sums), len(model.sums)
    base = [s // n for s in sums] if n else []
    basis = _basis(model) if len(model.values) else np.zeros((dims, 0))

    def run(batches):
        s, b = np.array(sums, object), np.array(base, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _rows(part.column(part.num_columns - 1), dims) if dims else np.zeros((part.num_rows, 0), np.int64)
                if dims:
                    _check(x, b, n)
                away = [Decimal(v) for v in _square_sums(_centred(x, n, s, b).T)] if dims else [Decimal(0)] * part.num_rows
                w = _projected(x, n, s, b, basis) if dims else np.zeros((part.num_rows, 0))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(away, pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))], names=out.names)
    return src.mapInArrow(run, out)


def _check(x: np.ndarray, base: np.ndarray, n: int) -> None:
    """Rows outside the fit list may lie further out than all of it."""
    away = max(abs(int(x.max()) - int(base.min())), abs(int(base.max()) - int(x.min()))) + 1
    if n * away >= LARGEST:
        raise ValueError("centred values are too large to be squared exactly")
