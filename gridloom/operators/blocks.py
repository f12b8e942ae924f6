"""Fields as sub-boxes, and the distributed solve on them.

A block is a row of a few keys and one array: ``rhs_id, comp, t0, t1, t2, values``.  The points (or modes) of each axis
are dealt into tiles; a block holds the box where three tiles meet, last axis fastest, complex values as pairs.  A
transform needs whole lines, so a step gathers all blocks that share the tiles of the other axes (one exchange of
arrays, not of points), transforms the box they make, and cuts it along the axes it has transformed into the blocks of
the next step.  The last axes are transformed, multiplied by the Green's function and transformed back in one step.

Green's functions are even along their unbounded axes, so only an octant is tabled: positions 0 to n of each line and,
by a cosine transform, as many modes; mode e of the field reads entry ``min(e, 2n - e)``.  Modes that read one entry
share a tile, so the table's blocks come to the task that has the modes in the exchange which the field's last
transform needs anyway; no rows are joined.  For the rotational equation that step holds all components of a box, so
the curl needs no exchange of its own.

Points that a field lacks read as 0, as in ``layout``."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import transforms as T
from gridloom.functions.kernels import GreenFill
from gridloom.operators import dense
from gridloom.operators.layout import AXES, FIELD, normalise
from gridloom.plans.spec import AxisClass, Diff, Equation, GridSpec, Kernel

TILES = ("t0", "t1", "t2")
BLOCK = "rhs_id long, comp int, t0 int, t1 int, t2 int, values array<double>"
_BLOCK = pa.schema([("rhs_id", pa.int64()), ("comp", pa.int32()), *((t, pa.int32()) for t in TILES), ("values", pa.list_(pa.float64()))])
_FIELD = pa.schema([("rhs_id", pa.int64()), ("comp", pa.int32()), *((a, pa.int32()) for a in AXES), ("v", pa.float64())])

#: points of the box that a task works on at once, for one component
BOX_POINTS = 1 << 18
#: tiles that the points of an axis make at least, so that small fields are spread too
LEAST_TILES = 4


@dataclass(frozen=True)
class Tiling:
    """Tiles of the points or modes of three axes.  Along an axis with ``fold`` set, indices e and fold - e share a tile."""

    extent: tuple[int, int, int]
    size: tuple[int, int, int]
    fold: tuple[int, int, int] = (0, 0, 0)

    def top(self, d: int) -> int:
        return self.fold[d] // 2 + 1 if self.fold[d] else self.extent[d]

    def tiles(self, d: int) -> int:
        return -(-self.top(d) // self.size[d])

    def folded(self, d: int, e: np.ndarray) -> np.ndarray:
        """Index of the entry that ``e`` shares."""
        return np.where(e > self.fold[d] // 2, self.fold[d] - e, e) if self.fold[d] else e

    def members(self, d: int, t: int) -> np.ndarray:
        """Indices in tile ``t``, ascending."""
        low = np.arange(t * self.size[d], min((t + 1) * self.size[d], self.top(d)))
        if not self.fold[d]:
            return low
        high = self.fold[d] - low[::-1]
        return np.concatenate([low, high[(high > self.fold[d] // 2) & (high < self.extent[d])]])


class BlockPlan:
    """Steps of a solve: which axes are whole in each, and the tilings between them."""

    def __init__(self, grid: GridSpec, slabs: bool = False, box_points: int | None = None):
        self.grid = grid
        axes = [d for d in grid.order if grid.axes[d].kind != AxisClass.EMPTY]
        self.groups = [axes[:2], axes[2:]] if slabs and len(axes) == 3 else [[d] for d in axes]
        points = box_points or BOX_POINTS
        size = [1, 1, 1]
        for d in axes:
            # every step in which the axis is tiled must fit; two tiled axes share what the whole ones leave
            room = points
            for group in self.groups:
                if d not in group:
                    whole = math.prod(max(grid.modes[a], grid.axes[a].n) for a in group)
                    others = len(axes) - len(group)
                    room = min(room, int(max(1, points / whole) ** (1 / others)))
            size[d] = max(1, min(room, -(-grid.axes[d].n // LEAST_TILES)))
        self.size = tuple(size)

    def tiling(self, done: int) -> Tiling:
        """Tiles once the first ``done`` groups are transformed."""
        g, gone = self.grid, [d for group in self.groups[:done] for d in group]
        extent = tuple(g.modes[d] if d in gone else p.n for d, p in enumerate(g.axes))
        fold = tuple(p.padded if d in gone and p.complex and not g.half(d) else 0 for d, p in enumerate(g.axes))
        return Tiling(extent, self.size, fold)

    def octant(self) -> Tiling:
        """Tiles of the Green's table, before and after its transforms."""
        g = self.grid
        extent = tuple(p.padded // 2 + 1 if p.complex else g.modes[d] for d, p in enumerate(g.axes))
        return Tiling(extent, self.size)

    def complex(self, done: int) -> bool:
        return any(self.grid.half(d) for group in self.groups[:done] for d in group)

    def others(self, step: int) -> list[int]:
        return [d for d in range(3) if d not in self.groups[step]]


# -- rows to boxes and back ---------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], list[pa.RecordBatch]]]:
    """Rows of equal keys, from sorted batches."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k)) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            k = tuple(int(c[i]) for c in cols)
            if k != key:
                if held:
                    yield key, held
                held, key = [], k
            held.append(b.slice(i, j - i))
    if held:
        yield key, held


def _index(tiling: Tiling, whole: list[int], tiles: dict[int, int]) -> list[np.ndarray]:
    """Indices of a box along each axis."""
    return [np.arange(tiling.extent[d]) if d in whole else tiling.members(d, tiles[d]) for d in range(3)]


def _fill(parts: list[pa.RecordBatch], tiling: Tiling, whole: list[int], index: list[np.ndarray], comps: list[int], is_complex: bool) -> np.ndarray:
    """The box (component, axes) of block rows or of points."""
    out = np.zeros((len(comps), *map(len, index)), complex if is_complex else float)
    for b in parts:
        comp = np.asarray(b.column("comp"))
        if "values" not in b.schema.names:
            at = [np.asarray(b.column(a)) - (0 if d in whole else index[d][0]) for d, a in enumerate(AXES)]
            out[tuple([np.searchsorted(comps, comp), *at])] = np.asarray(b.column("re"))
            continue
        values = b.column("values")
        flat, ends = np.asarray(values.flatten()), np.asarray(values.offsets) - values.offsets[0].as_py()
        tiles = [np.asarray(b.column(t)) for t in TILES]
        for r in range(b.num_rows):
            v = flat[ends[r] : ends[r + 1]]
            at = [tiling.members(d, int(tiles[d][r])) if d in whole else np.arange(len(index[d])) for d in range(3)]
            out[(comps.index(int(comp[r])), *np.ix_(*at))] = (v.view(complex) if is_complex else v).reshape([len(x) for x in at])
    return out


def _cut(x: np.ndarray, rhs: int, comps: list[int], tiling: Tiling, whole: list[int], tiles: dict[int, int]) -> pa.RecordBatch:
    """Blocks of a box, cut along its whole axes."""
    cuts = [[(t, tiling.members(d, t)) for t in range(tiling.tiles(d))] if d in whole else [(tiles[d], None)] for d in range(3)]
    keys, values = [], []
    for k, c in enumerate(comps):
        for t0, a in cuts[0]:
            for t1, b in cuts[1]:
                for t2, e in cuts[2]:
                    at = [np.arange(x.shape[d + 1]) if m is None else m for d, m in enumerate((a, b, e))]
                    keys.append((rhs, c, t0, t1, t2))
                    v = np.ascontiguousarray(x[k][np.ix_(*at)]).ravel()
                    values.append(v.view(float) if np.iscomplexobj(v) else v)
    off = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=off[1:])
    cols = [pa.array(c, f.type) for c, f in zip(zip(*keys), _BLOCK)]
    return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(values)))], schema=_BLOCK)


def _points(x: np.ndarray, rhs: int, comps: list[int], index: list[np.ndarray]) -> pa.RecordBatch:
    c, *at = (a.ravel() for a in np.meshgrid(np.array(comps), *index, indexing="ij"))
    cols = [np.full(x.size, rhs), c, *at, x.ravel()]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, _FIELD)], schema=_FIELD)


def _gathered(df: DataFrame, first: list[str], then: list[str]) -> DataFrame:
    """Rows of equal ``first`` in one partition, sorted by all keys: the one exchange of a step."""
    return df.repartition(*first).sortWithinPartitions(*first, *then)


# -- steps -----------------------------------------------------------------------------------


def _real(grid: GridSpec, d: int) -> bool:
    return grid.half(d) or grid.half_axis is None or grid.order.index(d) < grid.order.index(grid.half_axis)


def _there(grid: GridSpec, x: np.ndarray, d: int, comp: int) -> np.ndarray:
    return dense.along(lambda y: T.forward(grid.plan(d, comp), y.real if _real(grid, d) else y, grid.half(d)), x, d)


def _back(grid: GridSpec, x: np.ndarray, d: int, comp: int, derived: bool) -> np.ndarray:
    p = grid.plan(d, comp)
    return dense.along(lambda y: T.backward(p.derived() if derived else p, y, grid.half(d)), x, d)


def _outer(plan: BlockPlan, step: int, forward: bool, derived: bool, points: bool):
    """A step before or after the last axes: one transform of each box."""
    grid, whole = plan.grid, plan.groups[step]
    tiled = plan.others(step)
    before, after = (plan.tiling(step), plan.tiling(step + 1)) if forward else (plan.tiling(step + 1), plan.tiling(step))
    is_complex = plan.complex(step if forward else step + 1)

    def run(batches):
        for (rhs, comp, *t), parts in _runs(batches, ["rhs_id", "comp", *(TILES[d] for d in tiled)]):
            tiles = dict(zip(tiled, t))
            x = _fill(parts, before, whole, _index(before, whole, tiles), [comp], is_complex)[0]
            for d in whole if forward else reversed(whole):
                x = _there(grid, x, d, comp) if forward else _back(grid, x, d, comp, derived)
            if points:
                yield _points(x.real[None], rhs, [comp], _index(after, whole, tiles))
            else:
                yield _cut(x[None], rhs, [comp], after, whole, tiles)

    return run


def _green_part(plan: BlockPlan, fill: GreenFill, tiles: dict[int, int], parts: list[pa.RecordBatch] | None) -> np.ndarray:
    """The Green's function on the octant modes of a box of the last step, scaled to the transforms."""
    grid, last, octant = plan.grid, plan.groups[-1], plan.octant()
    index = _index(octant, last, tiles)
    if parts is None:
        g = np.array(np.broadcast_to(fill.sample(*np.ix_(*index)), [len(e) for e in index]), float)
    else:
        g = _fill(parts, octant, last, index, [-1], False)[0]
    for d in last:
        if grid.axes[d].unbounded:
            g = dense.along(T.dct1, g, d)
    return fill.overwrite(*np.ix_(*index), g * grid.volfact)


def _inner(plan: BlockPlan, fill: GreenFill, equation: Equation, diff: Diff, tabled: bool, points: bool):
    """The step of the last axes: there, Green's function (and curl), and back."""
    grid, whole, tiled = plan.grid, plan.groups[-1], plan.others(len(plan.groups) - 1)
    tiling, modes = plan.tiling(len(plan.groups) - 1), plan.tiling(len(plan.groups))
    is_complex, rot, octant = plan.complex(len(plan.groups) - 1), equation == Equation.ROT, plan.octant()
    keys = [*(TILES[d] for d in tiled), *(["data"] if tabled else []), "rhs_id", *([] if rot else ["comp"])]

    def run(batches):
        at, green = None, None
        for key, parts in _runs(batches, keys):
            t, rest = key[: len(tiled)], key[len(tiled) :]
            tiles = dict(zip(tiled, t))
            if tabled and rest[0] == 0:
                at, green = t, _green_part(plan, fill, tiles, parts)
                continue
            if not tabled and t != at:
                at, green = t, _green_part(plan, fill, tiles, None)
            rhs = rest[1] if tabled else rest[0]
            comps = [0, 1, 2] if rot else [rest[-1]]
            x = _fill(parts, tiling, whole, _index(tiling, whole, tiles), comps, is_complex)
            e = _index(modes, whole, tiles)
            y = []
            for c, one in zip(comps, x):
                for d in whole:
                    one = _there(grid, one, d, c)
                y.append(one)
            y = np.stack(y)
            if rot:
                y = dense.curl(grid, fill, y, diff, e)
            # mirrored modes read the entry of their twin
            entry = [modes.folded(d, e[d]) if modes.fold[d] else e[d] for d in range(3)]
            y *= green[np.ix_(*(i - (0 if d in whole else tiles[d] * octant.size[d]) for d, i in enumerate(entry)))]
            y *= grid.normfact
            out = []
            for c, one in zip(comps, y):
                for d in reversed(whole):
                    one = _back(grid, one, d, c, rot)
                out.append(one)
            if points:
                yield _points(np.stack(out).real, rhs, comps, _index(tiling, whole, tiles))
            else:
                yield _cut(np.stack(out), rhs, comps, tiling, whole, tiles)

    return run


# -- the Green's table -------------------------------------------------------------------------


def _sampler(spark: SparkSession, grid: GridSpec, kernel: Kernel, alpha: float) -> GreenFill:
    from gridloom.operators import lattice  # which gathers its own sums by the functions here

    return lattice.fill(spark, grid, kernel, alpha)


def green_blocks(spark: SparkSession, grid: GridSpec, kernel: Kernel, alpha: float = 2.0, slabs: bool = False, box_points: int | None = None) -> DataFrame | None:
    """Octant of the Green's function, transformed along the unbounded axes of all steps but the last, as blocks of
    component -1; None where the last step can sample what it needs by itself."""
    plan, fill = BlockPlan(grid, slabs, box_points), _sampler(spark, grid, kernel, alpha)
    steps = [s for s, group in enumerate(plan.groups[:-1]) if any(grid.axes[d].unbounded for d in group)]
    octant, df = plan.octant(), None
    for s in steps:
        df = _green_step(spark, plan, fill, octant, s, df)
    return df


def _green_step(spark: SparkSession, plan: BlockPlan, fill: GreenFill, octant: Tiling, step: int, df: DataFrame | None) -> DataFrame:
    whole, tiled = plan.groups[step], plan.others(step)

    def transformed(tiles, g):
        for d in whole:
            if plan.grid.axes[d].unbounded:
                g = dense.along(T.dct1, g, d)
        return _cut(g[None], 0, [-1], octant, whole, tiles)

    if df is None:  # boxes are sampled where they are first transformed
        n = [octant.tiles(d) for d in tiled]

        def sample(batches):
            for b in batches:
                for k in b.column("id").to_pylist():
                    tiles, index = {}, k
                    for d, m in zip(tiled, n):
                        index, tiles[d] = divmod(index, m)
                    e = _index(octant, whole, tiles)
                    yield transformed(tiles, np.array(np.broadcast_to(fill.sample(*np.ix_(*e)), [len(x) for x in e]), float))

        return spark.range(math.prod(n)).mapInArrow(sample, BLOCK)

    def run(batches):
        for t, parts in _runs(batches, [TILES[d] for d in tiled]):
            tiles = dict(zip(tiled, t))
            yield transformed(tiles, _fill(parts, octant, whole, _index(octant, whole, tiles), [-1], False)[0])

    return _gathered(df, [TILES[d] for d in tiled], []).mapInArrow(run, BLOCK)


# -- the solve -------------------------------------------------------------------------------


def _tile_columns(plan: BlockPlan, tiled: list[int]) -> dict:
    return {TILES[d]: F.floor(F.col(AXES[d]) / plan.size[d]).cast("int") for d in tiled}


def to_blocks(field: DataFrame, grid: GridSpec, slabs: bool = False, box_points: int | None = None) -> DataFrame:
    """A field of points as blocks (one exchange)."""
    plan = BlockPlan(grid, slabs, box_points)
    tiling = plan.tiling(0)

    def run(batches):
        for (rhs, comp, *t), parts in _runs(batches, ["rhs_id", "comp", *TILES]):
            tiles = dict(enumerate(t))
            x = _fill(parts, tiling, [], _index(tiling, [], tiles), [comp], False)
            yield _cut(x, rhs, [comp], tiling, [], tiles)

    rows = normalise(field).drop("im").withColumns(_tile_columns(plan, [0, 1, 2]))
    return _gathered(rows, ["rhs_id", "comp", *TILES], []).mapInArrow(run, BLOCK)


def from_blocks(blocks: DataFrame, grid: GridSpec, slabs: bool = False, box_points: int | None = None) -> DataFrame:
    """Blocks of a field as points (no exchange)."""
    tiling = BlockPlan(grid, slabs, box_points).tiling(0)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                rhs, comp, *t = (one.column(k)[0].as_py() for k in ("rhs_id", "comp", *TILES))
                index = _index(tiling, [], dict(enumerate(t)))
                yield _points(_fill([one], tiling, [], index, [comp], False), rhs, [comp], index)

    return blocks.mapInArrow(run, FIELD)


def solve(
    grid: GridSpec, field: DataFrame, kernel: Kernel, equation: Equation = Equation.STD, diff: Diff = Diff.NOD, alpha: float = 2.0, slabs: bool = False,
    green: DataFrame | None = None, box_points: int | None = None,
) -> DataFrame:
    """Solution of a field of points, as points, or of blocks, as blocks.  ``green``: stored ``green_blocks`` of this problem."""
    plan, fill = BlockPlan(grid, slabs, box_points), GreenFill(grid, kernel, alpha)
    rot, last = equation == Equation.ROT, len(plan.groups) - 1
    blocks = "values" in field.columns
    state = field if blocks else normalise(field).drop("im").withColumns(_tile_columns(plan, plan.others(0)))
    for s in range(last):
        state = _gathered(state, ["rhs_id", "comp", *(TILES[d] for d in plan.others(s))], []).mapInArrow(_outer(plan, s, True, False, False), BLOCK)
    tiles = [TILES[d] for d in plan.others(last)]
    if green is None:
        green = green_blocks(field.sparkSession, grid, kernel, alpha, slabs, box_points)
    if green is not None:  # the table's blocks sort before the field's
        fill.load(np.empty(0))  # nothing is sampled any more
        state = green.withColumn("data", F.lit(0)).unionByName(state.withColumn("data", F.lit(1)))
        state = _gathered(state, tiles, ["data", "rhs_id", "comp"])
    else:
        state = _gathered(state, [*tiles, "rhs_id", *([] if rot else ["comp"])], ["comp"] if rot else [])
    points = not blocks and last == 0
    state = state.mapInArrow(_inner(plan, fill, equation, diff, green is not None, points), FIELD if points else BLOCK)
    for s in reversed(range(last)):
        points = not blocks and s == 0
        rows = _gathered(state, ["rhs_id", "comp", *(TILES[d] for d in plan.others(s))], [])
        state = rows.mapInArrow(_outer(plan, s, False, rot, points), FIELD if points else BLOCK)
    return state
