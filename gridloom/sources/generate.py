"""Generated fields as DataFrames: manufactured problems, vortex tubes and symmetric vector fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import fields
from gridloom.operators.layout import AXES, index_table, position
from gridloom.plans.spec import GridSpec


class _Columns:
    """The few functions that fields need, on Columns."""

    sin, cos, exp = staticmethod(F.sin), staticmethod(F.cos), staticmethod(F.exp)

    @staticmethod
    def where(condition, a, b):
        return F.when(condition, a).otherwise(b)


def positions(grid: GridSpec) -> list[Column]:
    return [position(grid, d, F.col(a)) for d, a in enumerate(AXES)]


def field_frame(spark: SparkSession, grid: GridSpec, which: str = "rhs") -> DataFrame:
    """Right-hand side ("rhs") or solution ("solution") of the manufactured problem, all components."""
    out = None
    for c in range(grid.components):
        rhs, sol = fields.manufactured(grid, positions(grid), _Columns, c)
        one = index_table(spark, grid.shape).select(F.lit(0).cast("long").alias("rhs_id"), F.lit(c).alias("comp"), *AXES, (rhs if which == "rhs" else sol).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def vector_frame(spark: SparkSession, grid: GridSpec, components) -> DataFrame:
    """A field of three Column functions of position."""
    x = positions(grid)
    rows = F.array(*(F.struct(F.lit(c).alias("comp"), (f(*x) + F.lit(0.0)).alias("v")) for c, f in enumerate(components)))
    return index_table(spark, grid.shape).select(F.lit(0).cast("long").alias("rhs_id"), *AXES, F.explode(rows).alias("r")).select("rhs_id", "r.comp", *AXES, "r.v")


def vortex_tube(spark: SparkSession, grid: GridSpec, axis: int = 2, sigma: float = 0.05, radius: float | None = None, mirror: tuple[int, int] = (0, 0), which: str = "rhs") -> DataFrame:
    """A straight vortex along ``axis`` through the middle of the domain: vorticity ("rhs") or velocity ("solution").

    Gaussian of width ``sigma``, or compact with ``radius``; ``mirror`` gives the signs of images beyond
    the far sides of the two other axes (0: none)."""
    a, b = [d for d in range(3) if d != axis]
    ca, cb = grid.axes[a].length / 2, grid.axes[b].length / 2
    images = [(ca, cb, 1.0)]
    if mirror[0]:
        images.append((3 * ca, cb, float(mirror[0])))
    if mirror[1]:
        images.append((ca, 3 * cb, float(mirror[1])))
    if all(mirror):
        images.append((3 * ca, 3 * cb, float(mirror[0] * mirror[1])))
    x = positions(grid)

    def swirl(pa, pb, sign):
        da, db = x[a] - pa, x[b] - pb
        r2 = da * da + db * db
        if radius is None:
            w = F.exp(r2 / (-2 * sigma**2)) / (2 * math.pi * sigma**2)
            u = F.when(r2 > 0, (1 - F.exp(r2 / (-2 * sigma**2))) / (2 * math.pi * r2)).otherwise(1 / (4 * math.pi * sigma**2))
        else:
            # profile proportional to (1 - r^2/R^2)^3 inside R, of circulation 1
            q = F.least(r2 / radius**2, F.lit(1.0))
            w = 4 / (math.pi * radius**2) * F.pow(1 - q, 3)
            u = F.when(r2 > 0, (1 - F.pow(1 - q, 4)) / (2 * math.pi * r2)).otherwise(2 / (math.pi * radius**2))
        return sign * w, sign * u * db * -1.0, sign * u * da

    parts = [swirl(*i) for i in images]
    total = [sum((p[j] for p in parts[1:]), parts[0][j]) for j in range(3)]
    zero = F.lit(0.0)
    turn = 1.0 if (a, b) in ((0, 1), (1, 2)) else -1.0  # (a, b, axis) right-handed or not
    value = {axis: total[0] * -1.0} if which == "rhs" else {a: total[1] * turn, b: total[2] * turn}
    return vector_frame(spark, grid, [lambda *_, d=d: value.get(d, zero) for d in range(3)])


def gaussian_line(spark: SparkSession, grid: GridSpec, axis: int = 0, sigma: float = 0.1, which: str = "rhs") -> DataFrame:
    """A solution that varies along one unbounded axis only, as a Gaussian in its middle ("solution"), or its Laplacian ("rhs")."""
    x = positions(grid)[axis]
    v = fields.gaussian(x, _Columns, grid.axes[axis].length / 2, sigma, which == "rhs")
    return index_table(spark, grid.shape).select(F.lit(0).cast("long").alias("rhs_id"), F.lit(0).alias("comp"), *AXES, v.alias("v"))


def gaussian_blob(spark: SparkSession, grid: GridSpec, sigma: float = 0.05, which: str = "rhs") -> DataFrame:
    """A Gaussian of unit mass in the middle of an unbounded domain, or the potential it causes."""
    import numpy as np
    import pyarrow as pa

    from gridloom.functions.special import erf

    x = positions(grid)
    r2 = sum(((c - p.length / 2) * (c - p.length / 2) for c, p in zip(x, grid.axes)), F.lit(0.0))
    base = index_table(spark, grid.shape).select(F.lit(0).cast("long").alias("rhs_id"), F.lit(0).alias("comp"), *AXES, r2.alias("v"))
    if which == "rhs":
        return base.withColumn("v", F.exp(F.col("v") / (-2 * sigma**2)) / (2 * math.pi * sigma**2) ** 1.5)

    def potential(batches):
        for b in batches:
            r = np.sqrt(np.asarray(b.column("v")))
            safe = np.where(r > 0, r, 1.0)
            v = np.where(r > 0, -erf(safe / (math.sqrt(2) * sigma)) / (4 * math.pi * safe), -math.sqrt(2 / math.pi) / (4 * math.pi * sigma))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rhs_id", "comp", *AXES)), pa.array(v)], names=["rhs_id", "comp", *AXES, "v"])

    return base.mapInArrow(potential, base.schema)


def shear_waves(spark: SparkSession, grid: GridSpec, which: str = "rhs") -> DataFrame:
    """A periodic vector field (sin ky, sin kz, sin kx) and the solution of lap u = curl f, -curl f / k^2."""
    k = [2 * math.pi / p.length for p in grid.axes]
    if which == "rhs":
        return vector_frame(spark, grid, [lambda x, y, z: F.sin(y * k[1]), lambda x, y, z: F.sin(z * k[2]), lambda x, y, z: F.sin(x * k[0])])
    return vector_frame(spark, grid, [lambda x, y, z: F.cos(z * k[2]) / k[2], lambda x, y, z: F.cos(x * k[0]) / k[0], lambda x, y, z: F.cos(y * k[1]) / k[1]])


def wall_waves(spark: SparkSession, grid: GridSpec, which: str = "rhs") -> DataFrame:
    """A field along the last axis between odd walls of the first two, and the solution of lap u = curl f."""
    a, b = math.pi / grid.axes[0].length, 2 * math.pi / grid.axes[1].length
    k2 = a * a + b * b
    zero = lambda x, y, z: F.lit(0.0)
    if which == "rhs":
        return vector_frame(spark, grid, [zero, zero, lambda x, y, z: F.sin(x * a) * F.sin(y * b)])
    return vector_frame(spark, grid, [lambda x, y, z: F.sin(x * a) * F.cos(y * b) * (-b / k2), lambda x, y, z: F.cos(x * a) * F.sin(y * b) * (a / k2), zero])
