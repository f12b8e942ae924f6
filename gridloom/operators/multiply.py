"""Pointwise work in spectral space: the Green's function, the curl, and user filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.kernels import GreenFill, spectral
from gridloom.operators import lattice
from gridloom.operators.dense import derivative_factor, phase
from gridloom.operators.layout import AXES, index_table, wave_number
from gridloom.operators.transform import green_axis
from gridloom.plans.spec import Diff, GridSpec, Kernel

#: a Green's table of up to so many rows may be broadcast
BROADCAST_ROWS = 200_000


def spectral_green(grid: GridSpec, kernel: Kernel, alpha: float = 2.0) -> Column:
    """Closed form over the mode columns where every axis is spectral: no table, no join."""
    fill = GreenFill(grid, kernel, alpha)
    k = [wave_number(grid, d, F.col(a)) for d, a in enumerate(AXES)]
    g = spectral(kernel, k, fill.eps, grid.h, F)
    still = (k[0] == 0) & (k[1] == 0) & (k[2] == 0)
    return F.when(still, F.lit(0.0)).otherwise(g)


def green_table(spark: SparkSession, grid: GridSpec, kernel: Kernel, alpha: float = 2.0) -> DataFrame:
    """i0, i1, i2, g on the spectral grid: sampled in Arrow batches, then transformed along the unbounded axes."""
    fill = lattice.fill(spark, grid, kernel, alpha)
    if not grid.unbounded:
        return index_table(spark, grid.modes).withColumn("g", spectral_green(grid, kernel, alpha))
    shape = fill.shape()

    def sample(batches):
        for b in batches:
            e = [np.asarray(b.column(a)) for a in AXES]
            g = np.asarray(fill.sample(*e), float)
            n = len(g)
            zero = np.zeros(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), *(pa.array(x, pa.int32()) for x in e), pa.array(g), pa.array(zero)], names=["rhs_id", "comp", *AXES, "re", "im"])

    df = index_table(spark, shape).mapInArrow(sample, "rhs_id long, comp int, i0 int, i1 int, i2 int, re double, im double")
    for d in grid.order:
        if grid.axes[d].unbounded:
            df = green_axis(grid, df, d, shape[d])
    g = F.col("re") * F.lit(grid.volfact)
    if fill.overwrites:
        axis = next(d for d in range(3) if not grid.axes[d].unbounded)
        k = [wave_number(grid, d, F.col(a)) for d, a in enumerate(AXES)]
        g = F.when(k[axis] != 0, spectral(kernel, k, fill.eps, grid.h, F)).otherwise(g)
    return df.select(*AXES, g.alias("g"))


def multiply(spectrum: DataFrame, grid: GridSpec, kernel: Kernel, alpha: float = 2.0, green: DataFrame | None = None) -> DataFrame:
    """Spectrum times Green's function and normalisation."""
    norm = F.lit(grid.normfact)
    if not grid.unbounded and green is None:
        out, g = spectrum, spectral_green(grid, kernel, alpha)
    else:
        green = green_table(spectrum.sparkSession, grid, kernel, alpha) if green is None else green
        points = int(np.prod(grid.modes))
        out, g = spectrum.join(F.broadcast(green) if points <= BROADCAST_ROWS else green, list(AXES)), F.col("g")
    return out.select("rhs_id", "comp", *AXES, (F.col("re") * g * norm).alias("re"), (F.col("im") * g * norm).alias("im"))


def curl(spectrum: DataFrame, grid: GridSpec, diff: Diff) -> DataFrame:
    """Curl of a three-component spectrum: one pivot of components, then column arithmetic."""
    if grid.components != 3 or diff == Diff.NOD:
        raise ValueError("a curl needs three components and a derivative")
    pick = [F.sum(F.when(F.col("comp") == c, F.col(x))).alias(f"{x}{c}") for c in range(3) for x in ("re", "im")]
    wide = spectrum.groupBy("rhs_id", *AXES).agg(*pick)
    k = [derivative_factor(diff, wave_number(grid, d, F.col(a)), grid.h[d], F) for d, a in enumerate(AXES)]

    def d(axis: int, c: int, to: int) -> tuple[Column, Column]:
        re, im = (F.coalesce(F.col(f"{x}{c}"), F.lit(0.0)) for x in ("re", "im"))
        p = phase(grid, axis, c, to)
        return (-k[axis] * im, k[axis] * re) if p == 1j else (k[axis] * re * p.real, k[axis] * im * p.real)

    rows = []
    for to, (a, b) in enumerate((((1, 2), (2, 1)), ((2, 0), (0, 2)), ((0, 1), (1, 0)))):
        (r1, i1), (r2, i2) = d(*a, to), d(*b, to)
        rows.append(F.struct(F.lit(to).alias("comp"), (r1 - r2).alias("re"), (i1 - i2).alias("im")))
    return wide.select("rhs_id", *AXES, F.explode(F.array(*rows)).alias("x")).select("rhs_id", "x.comp", *AXES, "x.re", "x.im")


def apply_spectral(spectrum: DataFrame, grid: GridSpec, f) -> DataFrame:
    """User filter: ``f(k0, k1, k2, re, im)`` on Columns gives the new (re, im)."""
    k = [wave_number(grid, d, F.col(a)) for d, a in enumerate(AXES)]
    re, im = f(*k, F.col("re"), F.col("im"))
    return spectrum.select("rhs_id", "comp", *AXES, re.alias("re"), im.alias("im"))
