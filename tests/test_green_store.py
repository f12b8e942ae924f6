"""Lattice tables made by tasks, and Green's tables that outlive their session."""

import os

import numpy as np
import pytest

from gridloom.functions import special as S
from gridloom.functions.kernels import GreenFill
from gridloom.operators import blocks, dense, lattice, report
from gridloom.plans.spec import GridSpec, Kernel
from gridloom.solver import FieldSolver
from gridloom.sources.library import GreenLibrary


@pytest.mark.parametrize("axes,kernel,reach", [(3, Kernel.LGF_4, 6), (3, Kernel.MEHR_6F, 3), (2, Kernel.LGF_8, 30), (2, Kernel.MEHR_4L, 9)])
def test_tasks_make_the_table(spark, axes, kernel, reach):
    want = (S.table3 if axes == 3 else S.table2)(kernel, reach)
    assert np.allclose(lattice.table(spark, kernel, axes, reach), want, rtol=0, atol=1e-14)
    table = lattice.planes(spark, kernel, axes, reach, 17)
    assert len(report.exchanges(table)) == 1 and table.count() == reach + 1
    assert lattice.table(spark, kernel, axes, reach) is lattice.table(spark, kernel, axes, reach)


def test_fills_take_it(spark, monkeypatch):
    """From some size on the driver integrates nothing."""
    monkeypatch.setattr(lattice, "LEAST_REACH", 4)
    g = GridSpec.of("444433", 4)
    want = dense.green(g, Kernel.LGF_6)
    monkeypatch.setattr(S, "table2", None)
    fill = lattice.fill(spark, g, Kernel.LGF_6)
    assert np.allclose(fill.table, lattice.table(spark, Kernel.LGF_6, 2, 4))
    f = np.random.default_rng(0).normal(size=(1, 4, 4, 4))
    rows = [(int(i), int(j), int(k), float(v)) for (_, i, j, k), v in np.ndenumerate(f)]
    u = blocks.solve(g, spark.createDataFrame(rows, "i0 int, i1 int, i2 int, v double"), Kernel.LGF_6).toPandas()
    got = np.zeros((1, 4, 4, 4))
    got[0, u["i0"], u["i1"], u["i2"]] = u["v"]
    assert np.allclose(got, dense.solve(g, f, Kernel.LGF_6, g=want), atol=1e-12)


def test_partial_planes_add_up():
    for axes in (2, 3):
        parts = [S.partial_plane(Kernel.LGF_2, axes, 5, 2, slice(i, i + 50)) for i in range(0, S.node_count(5), 50)]
        assert np.allclose(sum(parts), (S.table3 if axes == 3 else S.table2)(Kernel.LGF_2, 5)[..., 2], atol=1e-14)
    assert GreenFill(GridSpec.of("444444", 30), Kernel.LGF_2).reach == 30 and GreenFill(GridSpec.of("444444", 90), Kernel.LGF_2).reach == 48


def test_a_second_solver_reads_the_stored_table(spark, tmp_path):
    g = GridSpec.of("444444", 5)
    rng = np.random.default_rng(1)
    rows = [(int(i), int(j), int(k), float(v)) for (i, j, k), v in np.ndenumerate(rng.normal(size=(5, 5, 5)))]
    f = spark.createDataFrame(rows, "i0 int, i1 int, i2 int, v double")
    want = sorted(map(tuple, FieldSolver(spark, g, Kernel.HEJ_4, strategy="pencil").solve(f).collect()))
    library = GreenLibrary(spark, f"file://{tmp_path}/library")
    first = sorted(map(tuple, FieldSolver(spark, g, Kernel.HEJ_4, strategy="pencil", library=library).solve(f).collect()))
    (name,) = os.listdir(tmp_path / "library")
    stored = {n: os.stat(tmp_path / "library" / name / n).st_mtime_ns for n in os.listdir(tmp_path / "library" / name)}
    other = GreenLibrary(spark.newSession(), f"file://{tmp_path}/library/")
    solver = FieldSolver(spark, g, Kernel.HEJ_4, strategy="pencil", library=other)
    plan = solver.solve(f)
    assert sorted(map(tuple, plan.collect())) == first and np.allclose(first, want, atol=1e-12)
    assert stored == {n: os.stat(tmp_path / "library" / name / n).st_mtime_ns for n in os.listdir(tmp_path / "library" / name)}
    assert "Scan parquet" in plan._jdf.queryExecution().executedPlan().toString()
    assert "persist" not in str(solver.octant().storageLevel) and not solver.octant().storageLevel.useMemory
    # other grids, kernels, lengths and tiles have tables of their own; those that need none store none
    names = {library.name(*x) for x in [(g, Kernel.HEJ_4, 2.0, False), (g, Kernel.HEJ_4, 2.0, True), (g, Kernel.HEJ_4, 2.5, False), (g, Kernel.HEJ_6, 2.0, False), (GridSpec.of("444444", 6), Kernel.HEJ_4, 2.0, False), (GridSpec.of("444433", 5), Kernel.HEJ_4, 2.0, False)]}
    assert len(names) == 6
    assert library.octant(GridSpec.of("003333", 4), Kernel.HEJ_4) is None and len(os.listdir(tmp_path / "library")) == 1
