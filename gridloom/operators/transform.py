"""Distributed transforms: lines in Arrow batches, whole slabs, or whole fields per task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.functions import transforms as T
from gridloom.operators import dense
from gridloom.operators.layout import AXES, KEYS, SPECTRUM, to_lines
from gridloom.plans.spec import GridSpec

_TYPES = {"rhs_id": pa.int64(), "comp": pa.int32(), "i0": pa.int32(), "i1": pa.int32(), "i2": pa.int32()}
_ARROW = pa.schema([*_TYPES.items(), ("re", pa.float64()), ("im", pa.float64())])


def _lines(batches: Iterator[pa.RecordBatch], axis: int, transform, width) -> Iterator[pa.RecordBatch]:
    """Apply ``transform(component, lines, keys)`` to batches of line rows; emits long rows."""
    rest = [k for k in KEYS if k != AXES[axis]]
    for batch in batches:
        pts = batch.column("pts")
        size = np.diff(np.asarray(pts.offsets))
        flat = pts.flatten()
        place, re, im = (np.asarray(flat.field(k)) for k in ("i", "re", "im"))
        who = np.repeat(np.arange(batch.num_rows), size)
        x = np.zeros((batch.num_rows, width), complex)
        x[who, place] = re + 1j * im
        keys = {k: np.asarray(batch.column(k)) for k in rest}
        for c in np.unique(keys["comp"]):
            rows = np.flatnonzero(keys["comp"] == c)
            lines = x[rows]
            y = np.asarray(transform(int(c), lines, {k: v[rows] for k, v in keys.items()}))
            n = y.shape[1]
            cols = {k: np.repeat(keys[k][rows], n) for k in rest}
            cols[AXES[axis]] = np.tile(np.arange(n, dtype=np.int32), len(rows))
            cols["re"], cols["im"] = y.real.ravel(), (y.imag if np.iscomplexobj(y) else np.zeros_like(y)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _ARROW], schema=_ARROW)


def _map_lines(df: DataFrame, axis: int, transform, width: int) -> DataFrame:
    lines = df if "pts" in df.columns else to_lines(df, axis)  # lines that a user has gathered need no exchange
    return lines.mapInArrow(lambda it: _lines(it, axis, transform, width), SPECTRUM)


def _real_before(grid: GridSpec, axis: int) -> bool:
    """Data stay real up to the axis that turns them complex."""
    return grid.half(axis) or grid.half_axis is None or grid.order.index(axis) < grid.order.index(grid.half_axis)


def forward_axis(grid: GridSpec, df: DataFrame, axis: int) -> DataFrame:
    """Transform along one axis: one exchange, then Arrow batches of whole lines."""
    half = grid.half(axis)

    real = _real_before(grid, axis)
    return _map_lines(df, axis, lambda c, x, _: T.forward(grid.plan(axis, c), x.real if real else x, half), grid.axes[axis].n)


def backward_axis(grid: GridSpec, df: DataFrame, axis: int, derived: bool = False) -> DataFrame:
    half = grid.half(axis)

    def run(c, y, _):
        p = grid.plan(axis, c)
        return T.backward(p.derived() if derived else p, y, half)

    return _map_lines(df, axis, run, grid.modes[axis])


def green_axis(grid: GridSpec, df: DataFrame, axis: int, width: int) -> DataFrame:
    p, half = grid.axes[axis], grid.half(axis)
    return _map_lines(df, axis, lambda c, x, _: T.green_forward(p, x.real, half), width)


def _slab(grid: GridSpec, last: int, direction: str, derived: bool):
    """Both transforms of a slab (fixed index of the last axis) in one Python call."""
    first = [d for d in (grid.order if direction == "forward" else reversed(grid.order)) if d != last]
    size = {d: (grid.axes[d].n if direction == "forward" else grid.modes[d]) for d in first}

    def run(key, table):
        comp = int(key[1].as_py())
        a, b = sorted(first)
        x = np.zeros((size[a], size[b]), complex)
        x[np.asarray(table.column(AXES[a])), np.asarray(table.column(AXES[b]))] = np.asarray(table.column("re")) + 1j * np.asarray(table.column("im"))
        for d in first:
            p, half = grid.plan(d, comp), grid.half(d)
            p = p.derived() if derived else p
            axis = 0 if d == a else 1
            if direction == "forward":
                real = _real_before(grid, d)
                x = dense.along(lambda y: T.forward(p, y.real if real else y, half), x, axis)  # noqa: B023
            else:
                x = dense.along(lambda y: T.backward(p, y, half), x, axis)  # noqa: B023
        i, j = np.indices(x.shape, dtype=np.int32)
        n = x.size
        cols = {"rhs_id": np.full(n, key[0].as_py()), "comp": np.full(n, comp), AXES[a]: i.ravel(), AXES[b]: j.ravel(), AXES[last]: np.full(n, key[2].as_py())}
        cols["re"], cols["im"] = x.real.ravel(), (x.imag if np.iscomplexobj(x) else np.zeros_like(x)).ravel()
        return pa.table([pa.array(cols[f.name], f.type) for f in _ARROW], schema=_ARROW)

    return run


def forward(grid: GridSpec, df: DataFrame, slabs: bool = False) -> DataFrame:
    """All transforms of a field, in the grid's order.  ``df`` may hold lines along the first axis of that order already
    (``layout.to_lines``), unless slabs are asked for.  Slabs need the plane of the first two axes of
    that order to fit a task and save one exchange."""
    if slabs:
        last = grid.order[2]
        planes = df.groupBy("rhs_id", "comp", AXES[last]).applyInArrow(_slab(grid, last, "forward", False), SPECTRUM)
        return planes if grid.axes[last].n == 1 else forward_axis(grid, planes, last)
    for axis in grid.order:
        if grid.axes[axis].kind.name != "EMPTY":
            df = forward_axis(grid, df, axis)
    return df


def backward(grid: GridSpec, df: DataFrame, slabs: bool = False, derived: bool = False) -> DataFrame:
    if slabs:
        last = grid.order[2]
        if grid.axes[last].n > 1:
            df = backward_axis(grid, df, last, derived)
        return df.groupBy("rhs_id", "comp", AXES[last]).applyInArrow(_slab(grid, last, "backward", derived), SPECTRUM)
    for axis in reversed(grid.order):
        if grid.axes[axis].kind.name != "EMPTY":
            df = backward_axis(grid, df, axis, derived)
    return df
