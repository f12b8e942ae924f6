"""Whitening of embeddings by an exact integer scatter matrix.

Vectors become integers, a shift is subtracted, and sums and cross-products are accumulated without any rounding: in
each task by matrix products whose terms cannot exceed what a double or a long holds exactly, across tasks as limbs of
``LIMB`` bits in long columns that Spark sums.  The driver puts the limbs of the d x d sums together (their number
depends on the dimension only), forms n X'X - S S' in whole numbers and only then turns to floating point and ``eigh``.
The shift cancels in that difference, so it changes no result; it keeps the numbers small.

Defined results
---------------
* Rows whose vector is null or holds null or non-finite entries are dropped; entries of 2^480 or more (no 32-bit ones)
  count as such.  The dimension is the most frequent length of the rest (of equally frequent ones the longest); rows
  of other lengths are dropped too.
* A component without variance (one row, constant or dependent dimensions) has ``whitened`` and ``explained`` 0.
  There are as many components as dimensions, up to 8.
* Rows that repeat a ``vec_id`` are rows of their own; a null ``vec_id`` is carried along; extra columns are ignored.
* Without any remaining row the result is empty.  A ``deviation`` beyond 64 bits is null.
* Equal eigenvalues have components in the order and direction that ``eigh`` gives them, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 1024.0
#: what a vector's integers are moved by, and the shift that is subtracted from them: x = floor(1024 c) + OFFSET
OFFSET = 100_000
COMPONENTS = 8
#: entries from here on count as infinite
LARGEST = 2.0**480
#: bits of a limb: long columns hold the sums of 2^32 of them
LIMB = 30
_MASK = (1 << LIMB) - 1


def _usable(column: str):
    x = F.col(column)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    return x.isNotNull() & F.coalesce(good, F.lit(False))


def usable(rows: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """Rows that take part, as ``vec_id, x array<double>``, and their dimension (0: there are none)."""
    rows = rows.select("vec_id", F.col(column).cast("array<double>").alias("x")).where(_usable("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k")).where("d > 0")
    most = sizes.agg(F.max(F.struct("k", "d"))["d"]).first()[0]
    return rows.where(F.size("x") == (most or 0)), most or 0


def shifted(column: pa.Array, d: int) -> np.ndarray:
    """x less the shift ``OFFSET``, which is floor(1024 c), for a batch of vectors: longs, or Python integers where those do not reach."""
    c = np.floor(np.asarray(column.flatten(), float).reshape(-1, d) * SCALE)  # a power of two: exact
    if np.abs(c).max(initial=0.0) < 2.0**62:
        return c.astype(np.int64)
    return np.array([[int(v) for v in row] for row in c], object)


def products(y: np.ndarray) -> np.ndarray:
    """y' y without rounding, as Python integers."""
    if y.dtype == object:
        return y.T @ y
    top, m = int(np.abs(y).max(initial=0)), len(y)
    if top * top < 1 << 53:
        out, step = np.zeros((y.shape[1], y.shape[1]), object), max(1, (1 << 53) // max(1, top * top))
        for i in range(0, m, step):  # every partial sum is a whole number below 2^53
            z = y[i : i + step].astype(float)
            out = out + (z.T @ z).astype(np.int64).astype(object)
        return out
    if top < 1 << 31 and m * top * top < 1 << 63:
        return (y.T @ y).astype(object)
    z = y.astype(object)
    return z.T @ z


def limbs(value: int) -> list[int]:
    """Base 2^30 digits from the lowest, with the sign of the number."""
    sign, value, out = (-1 if value < 0 else 1), abs(int(value)), []
    while value:
        out.append(sign * (value & _MASK))
        value >>= LIMB
    return out


def _scatter(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                y = shifted(batch.column("x"), d)
                n += len(y)
                total = total + (y.astype(object).sum(axis=0) if y.dtype == object or np.abs(y).max() >= 1 << 40 else y.sum(axis=0).astype(object))
                cross = cross + products(y)
        if not n:
            return
        rows = [(-1, -1, 0, n)]
        rows += [(i, -1, p, v) for i in range(d) for p, v in enumerate(limbs(total[i]))]
        rows += [(i, j, p, v) for i in range(d) for j in range(i, d) for p, v in enumerate(limbs(cross[i, j]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "place", "v"])

    return run


@dataclass(frozen=True)
class Moments:
    """n, S and X'X of shifted integer vectors, exactly."""

    n: int
    total: list[int]
    cross: list[list[int]]

    def scatter(self) -> list[list[int]]:
        """n X'X - S S', which no shift changes."""
        d = len(self.total)
        return [[self.n * self.cross[i][j] - self.total[i] * self.total[j] for j in range(d)] for i in range(d)]


def moments(rows: DataFrame, d: int) -> Moments:
    """Exact moments of ``rows(x)``; what comes to the driver depends on the dimension only."""
    parts = rows.select("x").mapInArrow(_scatter(d), "i int, j int, place int, v long").groupBy("i", "j", "place").agg(F.sum("v").alias("v"))
    n, total, cross = 0, [0] * d, [[0] * d for _ in range(d)]
    for i, j, place, v in parts.collect():
        v <<= LIMB * place
        if i < 0:
            n += v
        elif j < 0:
            total[i] += v
        else:
            cross[i][j] += v
            if i != j:
                cross[j][i] += v
    return Moments(n, total, cross)


@dataclass(frozen=True)
class Whitening:
    """Mean and components of integer vectors."""

    n: int
    total: list[int]
    vectors: np.ndarray  # (components, d), unit rows
    values: np.ndarray  # eigenvalues, falling
    explained: np.ndarray

    def centred(self, y: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(y - mean as doubles, rounded once; sum of (n y - S)^2 of each row, null beyond 64 bits)."""
        top = int(np.abs(y).max(initial=0))
        bound = self.n * top + max(map(abs, self.total), default=0)
        if y.dtype != object and bound * bound * y.shape[1] < 1 << 63:
            z = self.n * y - np.array(self.total, np.int64)
            return z / self.n, (z * z).sum(axis=1).tolist()
        z = self.n * y.astype(object) - np.array(self.total, object)
        squares = [int(v) for v in (z * z).sum(axis=1)]
        return (z / self.n).astype(float), [v if v < 1 << 63 else None for v in squares]

    def apply(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates, one column a component."""
        flat = self.values <= 0
        return np.where(flat, 0.0, centred @ self.vectors.T / np.sqrt(np.where(flat, 1.0, self.values)))


def fit(m: Moments, components: int = COMPONENTS) -> Whitening:
    """Leading components of the covariance scatter / n^2."""
    d = len(m.total)
    scatter = m.scatter()
    # the integers go to floating point here, over a common power of two so that none overflows
    bits = max(0, max((abs(v).bit_length() for row in scatter for v in row), default=0) - 900)
    v = np.array([[float(x / (1 << bits)) if bits else float(x) for x in row] for row in scatter]).reshape(d, d)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components].T
    trace = float(np.trace(v))
    # what rounding leaves of an eigenvalue that is zero
    values = np.where(values > d * np.finfo(float).eps * max(values.max(initial=0.0), 0.0), values, 0.0)
    explained = values / trace if trace > 0 else np.zeros_like(values)
    return Whitening(m.n, m.total, np.ascontiguousarray(vectors), values / m.n / m.n * 2.0**bits, explained)


def _second_moments(w: Whitening, d: int):
    def run(batches):
        k, total = len(w.values), 0.0
        for batch in batches:
            if batch.num_rows:
                z = w.apply(w.centred(shifted(batch.column("x"), d))[0])
                total = total + np.concatenate([z.sum(axis=0)[None], z.T @ z])
        if np.ndim(total):
            i, j = (x.ravel().astype(np.int32) for x in np.indices((k + 1, k)))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    return run


def identity_error(rows: DataFrame, w: Whitening, d: int) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity.  The vectors are centred exactly before they are
    projected; what rounding leaves of their mean is taken off too."""
    k = len(w.values)
    sums = np.zeros((k + 1, k))
    for i, j, v in rows.select("x").mapInArrow(_second_moments(w, d), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        sums[i, j] = v
    mean = sums[0] / w.n
    return float(np.abs(sums[1:] / w.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    kind = table.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = usable(table, column)
    if not d:
        return table.sparkSession.createDataFrame([], schema)
    w = fit(moments(rows, d), components)
    error, k = identity_error(rows, w, d), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            centred, deviation = w.centred(shifted(batch.column("x"), d))
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), deviation]
            cols += [pa.array(w.apply(centred).ravel()), pa.array(np.tile(w.explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
