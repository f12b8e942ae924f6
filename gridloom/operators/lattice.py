"""Lattice Green's functions near the origin, integrated by tasks.

A table's planes are sums over quadrature nodes: each task takes a plane and a block of nodes, and the partial sums of
a plane meet in one exchange.  What comes to the driver, to be sent along with a fill, is the finished octant of at
most ``kernels.LATTICE_REACH`` + 1 offsets an axis."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.functions import special as S
from gridloom.functions.kernels import GreenFill
from gridloom.operators.blocks import _runs
from gridloom.plans.spec import GridSpec, Kernel

#: nodes of a task
NODES = 64
#: tables of fewer offsets take less time than a job
LEAST_REACH = 24
_SCHEMA = "n int, values array<double>"
_tables: dict[tuple, np.ndarray] = {}


def _batch(n: int, values: np.ndarray) -> pa.RecordBatch:
    v = values.ravel()
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))], names=["n", "values"])


def planes(spark: SparkSession, kernel: Kernel, axes: int, reach: int, nodes: int = NODES) -> DataFrame:
    """``n, values``: for each offset n along the last axis, the table at offsets 0 to ``reach`` of the others."""
    blocks = -(-S.node_count(reach) // nodes)

    def parts(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                n, block = divmod(k, blocks)
                yield _batch(n, S.partial_plane(kernel, axes, reach, n, slice(block * nodes, (block + 1) * nodes)))

    def sums(batches):
        for (n,), rows in _runs(batches, ["n"]):
            yield _batch(n, sum(np.asarray(r.column("values").flatten()).reshape(r.num_rows, -1).sum(axis=0) for r in rows))

    work = spark.range((reach + 1) * blocks).mapInArrow(parts, _SCHEMA)
    return work.repartition("n").sortWithinPartitions("n").mapInArrow(sums, _SCHEMA)


def table(spark: SparkSession, kernel: Kernel, axes: int, reach: int) -> np.ndarray:
    """The table of ``special.table3`` or ``special.table2``, made by tasks; kept for later fills of this process."""
    key = (Kernel(kernel), axes, reach)
    if key not in _tables:
        out = np.empty((reach + 1,) * axes)
        for r in planes(spark, *key).collect():
            out[..., r["n"]] = np.reshape(r["values"], (reach + 1,) * (axes - 1))
        _tables[key] = out
    return _tables[key]


def fill(spark: SparkSession, grid: GridSpec, kernel: Kernel, alpha: float = 2.0) -> GreenFill:
    """A fill whose lattice table, if it needs one of some size, is made by tasks instead of the driver."""
    out = GreenFill(grid, kernel, alpha)
    if out.lattice and len(grid.unbounded) > 1 and out.reach >= LEAST_REACH:
        out.load(table(spark, out.kernel, len(grid.unbounded), out.reach))
    return out
