"""Transforms of array columns: one row per line, no exchange at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import transforms as T


def _matrix(column) -> np.ndarray:
    """Lines of one length as a matrix."""
    size = np.diff(np.asarray(column.offsets))
    if len(set(size.tolist())) > 1:
        raise ValueError("lines must have one length")
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    off = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(x).ravel()))


def transform(df: DataFrame, key: str, column: str, name: str, out: str = "y") -> DataFrame:
    """``key, out``: a real transform of every line, in Arrow batches."""
    f, kind = getattr(T, name), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(key), _lists(f(_matrix(b.column("_x"))))], names=[key, out])

    return df.select(key, F.col(column).cast("array<double>").alias("_x")).mapInArrow(run, f"{key} {kind}, {out} array<double>")


def dft(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, re, im``: half spectrum of every real line."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                y = np.fft.rfft(_matrix(b.column("_x")))
                yield pa.RecordBatch.from_arrays([b.column(key), _lists(y.real), _lists(y.imag)], names=[key, "re", "im"])

    return df.select(key, F.col(column).cast("array<double>").alias("_x")).mapInArrow(run, f"{key} {kind}, re array<double>, im array<double>")


def idft(df: DataFrame, key: str, n: int) -> DataFrame:
    """``key, y``: real lines of half spectra, not normalised."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                z = _matrix(b.column("re")) + 1j * _matrix(b.column("im"))
                yield pa.RecordBatch.from_arrays([b.column(key), _lists(np.fft.irfft(z, n) * n)], names=[key, "y"])

    return df.select(key, "re", "im").mapInArrow(run, f"{key} {kind}, y array<double>")


def basis_transform(line: Column, n: int, basis) -> Column:
    """The same sums as Column arithmetic: ``basis(k, j)`` gives the weights.  n^2 interpreted steps a line, so a
    demonstration for short lines; ``transform`` is the way for data."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.aggregate(
            F.zip_with(line, F.sequence(F.lit(0), F.lit(n - 1)), lambda x, j: x.cast("double") * basis(k, j)), F.lit(0.0), lambda a, x: a + x
        ),
    )
