"""Fourier transforms of lines that are longer than a task holds.

A line of n1 * n2 points is a matrix whose rows are n2 points apart.  Transforming its columns (n1 points each),
multiplying by twiddle factors and transforming its rows (n2 points each) gives all modes: two short transforms with one
exchange of blocks between them, and no task that ever has the line."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.blocks import _runs

#: complex values that a task transforms at once
PANEL = 1 << 18
_BLOCK = "rhs_id long, tile int, part int, values array<double>"
_MODES = "rhs_id long, k long, re double, im double"


def factors(n: int) -> tuple[int, int]:
    """n1 <= n2 with n1 * n2 = n, as near to each other as n has divisors."""
    n1 = next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)
    return n1, n // n1


def _complex(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(float).ravel()


def dft(points: DataFrame, n: int, sign: int = -1, panel: int = PANEL) -> DataFrame:
    """``rhs_id, k, re, im``: all modes of lines of ``n`` points, given as ``rhs_id, i, re`` and perhaps ``im`` (points that
    are missing are 0, those that repeat add up), not normalised.  ``sign`` 1 is the inverse transform."""
    n1, n2 = factors(n)
    # tiles of columns, and of modes along them
    width = [max(1, min(m, panel // other)) for m, other in ((n2, n1), (n1, n2))]
    im = F.col("im").cast("double") if "im" in points.columns else F.lit(0.0)
    rows = points.select("rhs_id", F.col("i").cast("long").alias("i"), F.coalesce(F.col("re").cast("double"), F.lit(0.0)).alias("re"), F.coalesce(im, F.lit(0.0)).alias("im"))
    rows = rows.withColumn("tile", F.floor(F.pmod("i", F.lit(n2)) / width[0]).cast("int"))

    def columns(batches):
        for (rhs, tile), parts in _runs(batches, ["rhs_id", "tile"]):
            low = tile * width[0]
            b = np.arange(low, min(low + width[0], n2))
            x = np.zeros((n1, len(b)), complex)
            for p in parts:
                i = np.asarray(p.column("i"))
                np.add.at(x, (i // n2, i % n2 - low), np.asarray(p.column("re")) + 1j * np.asarray(p.column("im")))
            y = np.fft.fft(x, axis=0) if sign < 0 else np.fft.ifft(x, axis=0, norm="forward")
            k1 = np.arange(n1)
            y *= np.exp(sign * 2j * np.pi * (k1[:, None] * b[None, :] % n) / n)
            cuts = [y[a : a + width[1]] for a in range(0, n1, width[1])]
            values = [_complex(c) for c in cuts]
            off = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            m = len(cuts)
            cols = [pa.array(np.full(m, rhs)), pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, tile, np.int32)), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(values)))]
            yield pa.RecordBatch.from_arrays(cols, names=["rhs_id", "tile", "part", "values"])

    def lines(batches):
        for (rhs, tile), parts in _runs(batches, ["rhs_id", "tile"]):
            k1 = np.arange(tile * width[1], min((tile + 1) * width[1], n1))
            x = np.zeros((len(k1), n2), complex)
            for p in parts:
                values = p.column("values")
                flat, ends = np.asarray(values.flatten()), np.asarray(values.offsets) - values.offsets[0].as_py()
                for r, part in enumerate(p.column("part").to_pylist()):
                    v = flat[ends[r] : ends[r + 1]].view(complex).reshape(len(k1), -1)
                    x[:, part * width[0] : part * width[0] + v.shape[1]] = v
            y = np.fft.fft(x, axis=1) if sign < 0 else np.fft.ifft(x, axis=1, norm="forward")
            k = (k1[:, None] + n1 * np.arange(n2)[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), rhs)), pa.array(k), pa.array(y.real.ravel()), pa.array(y.imag.ravel())], names=["rhs_id", "k", "re", "im"])

    gathered = lambda df: df.repartition("rhs_id", "tile").sortWithinPartitions("rhs_id", "tile")
    return gathered(gathered(rows).mapInArrow(columns, _BLOCK)).mapInArrow(lines, _MODES)
