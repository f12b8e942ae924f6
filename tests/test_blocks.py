import itertools
import math

import numpy as np
import pytest

from gridloom.operators import blocks, dense, multiply, report
from gridloom.plans.spec import Center, Diff, Equation, GridSpec, Kernel
from gridloom.solver import FieldSolver


def as_array(df, grid, rhs=0):
    rows = df.where(f"rhs_id = {rhs}").toPandas()
    assert len(rows) == grid.components * math.prod(grid.shape)
    out = np.full((grid.components, *grid.shape), np.nan)
    out[rows["comp"], rows["i0"], rows["i1"], rows["i2"]] = rows["v"]
    return out


def frame(spark, f, rhs=0):
    rows = [(rhs, int(c), int(i), int(j), int(k), float(v)) for (c, i, j, k), v in np.ndenumerate(f)]
    return spark.createDataFrame(rows, "rhs_id long, comp int, i0 int, i1 int, i2 int, v double")


def random_field(grid, seed=0):
    return np.random.default_rng(seed).normal(size=(grid.components, *grid.shape))


CASES = [
    ("444444", Center.CELL, Kernel.CHAT_2), ("444444", Center.NODE, Kernel.HEJ_4), ("444433", Center.CELL, Kernel.CHAT_2), ("444433", Center.CELL, Kernel.HEJ_6), ("443333", Center.NODE, Kernel.LGF_6),
    ("044414", Center.CELL, Kernel.CHAT_2), ("410044", Center.NODE, Kernel.CHAT_2), ("440033", Center.NODE, Kernel.MEHR_4L), ("001101", Center.CELL, Kernel.CHAT_2), ("333333", Center.NODE, Kernel.HEJ_4),
    ("443399", Center.CELL, Kernel.HEJ_2), ("404433", Center.NODE, Kernel.CHAT_2), ("013399", Center.CELL, Kernel.LGF_4),
]


@pytest.mark.parametrize("slabs", [False, True])
@pytest.mark.parametrize("code,center,kernel", CASES)
def test_equals_the_dense_solve(spark, code, center, kernel, slabs):
    g = GridSpec.of(code, (5, 5, 1) if code.endswith("99") else 5, center)
    f = random_field(g)
    assert np.allclose(as_array(blocks.solve(g, frame(spark, f), kernel, slabs=slabs), g), dense.solve(g, f, kernel), atol=1e-12)


@pytest.mark.parametrize("size", [1, 30, 1 << 18])
def test_any_size_of_boxes(spark, size):
    """From a point at a time to the tiles that the field's own size sets, with axes that tiles do not divide."""
    g = GridSpec(n=(7, 4, 5), bc=((4, 4), (3, 3), (0, 4)))
    f = random_field(g, 1)
    assert np.allclose(as_array(blocks.solve(g, frame(spark, f), Kernel.CHAT_2, box_points=size), g), dense.solve(g, f, Kernel.CHAT_2), atol=1e-12)


@pytest.mark.parametrize("code", ["333344", "444444", "001133"])
@pytest.mark.parametrize("diff", [Diff.SPE, Diff.FD4])
def test_curl_without_an_exchange_of_its_own(spark, code, diff):
    g = GridSpec.of(code, 4, components=3)
    f = random_field(g, 2)
    want = dense.solve(g, f, Kernel.CHAT_2, Equation.ROT, diff)
    for strategy, exchanges in (("pencil", 5), ("slab", 3)):
        with FieldSolver(spark, g, Kernel.CHAT_2, Equation.ROT, diff, strategy=strategy) as s:
            table = s.octant()
            own = report.exchanges(s.solve(frame(spark, f)))
            assert len(own) == exchanges or table is not None
            assert np.allclose(as_array(s.solve(frame(spark, f)), g), want, atol=1e-12)
            if table is None:  # one after the other, with a pivot of the components between
                assert len(report.exchanges(s.backward(s.multiply(s.forward(frame(spark, f)))))) > len(own)


def test_walls_of_other_components(spark):
    odd, even, free = (1, 1), (0, 0), (3, 3)
    g = GridSpec((4, 4, 4), ((even, odd, free), (odd, even, free), (odd, odd, free)), components=3)
    f = random_field(g, 3)
    for slabs in (False, True):
        u = blocks.solve(g, frame(spark, f), Kernel.CHAT_2, Equation.ROT, Diff.FD2, slabs=slabs)
        assert np.allclose(as_array(u, g), dense.solve(g, f, Kernel.CHAT_2, Equation.ROT, Diff.FD2), atol=1e-12)


def test_many_fields_share_one_table(spark):
    g = GridSpec.of("444433", 4, components=2)
    a, b = random_field(g, 4), random_field(g, 5)
    with FieldSolver(spark, g, strategy="pencil") as s:
        u = s.solve(frame(spark, a, 3).union(frame(spark, b, 1 << 40))).cache()
        assert np.allclose(as_array(u, g, 3), dense.solve(g, a, Kernel.CHAT_2), atol=1e-12)
        assert np.allclose(as_array(u, g, 1 << 40), dense.solve(g, b, Kernel.CHAT_2), atol=1e-12)
        assert s.octant().storageLevel.useMemory and s.octant() is s.octant()


def test_missing_points_and_an_empty_field(spark):
    g = GridSpec.of("444444", 4)
    f = np.zeros((1, 4, 4, 4))
    f[0, 1, 2, 3] = 2.0
    one = spark.createDataFrame([(1, 2, 3, 2.0), (0, 0, 0, None)], "i0 int, i1 int, i2 int, v double")
    for slabs in (False, True):
        assert np.allclose(as_array(blocks.solve(g, one, Kernel.CHAT_2, slabs=slabs), g), dense.solve(g, f, Kernel.CHAT_2), atol=1e-12)
        assert blocks.solve(g, one.limit(0), Kernel.CHAT_2, slabs=slabs).count() == 0


def test_blocks_in_blocks_out(spark):
    g = GridSpec.of("440033", 6)
    f = random_field(g, 6)
    b = blocks.to_blocks(frame(spark, f), g)
    assert b.count() == 3**3  # two points a tile along each axis
    assert np.array_equal(as_array(blocks.from_blocks(b, g), g), f)
    u = FieldSolver(spark, g, strategy="pencil").solve(b)
    assert u.columns == b.columns and np.allclose(as_array(blocks.from_blocks(u, g), g), dense.solve(g, f, Kernel.CHAT_2), atol=1e-12)


def test_no_row_per_point_between_axes(spark):
    """Bytes that go through the exchanges of blocks are those of the numbers, and the rows are boxes."""
    g = GridSpec.of("333300", 24)
    b = blocks.to_blocks(frame(spark, random_field(g, 7)), g).cache()
    assert b.count() == 64
    rows = report.measure(blocks.solve(g, b, Kernel.CHAT_2)).where("operator = 'Exchange'").collect()
    assert len(rows) == 5
    plan = blocks.BlockPlan(g)
    # real before the first complex transform and after the last one
    held = [math.prod(plan.tiling(s).extent) * (16 if plan.complex(s) else 8) for s in (0, 1, 2, 2, 1)]
    for r, numbers in zip(rows, held):
        assert r["rows"] <= 200 and numbers <= r["data_bytes"] < 1.1 * numbers


def test_table_holds_an_octant(spark):
    g = GridSpec.of("444444", 6)
    assert multiply.green_table(spark, g, Kernel.CHAT_2).count() == 7 * 12 * 12  # the half axis is folded there too
    table = blocks.green_blocks(spark, g, Kernel.CHAT_2)
    values = table.selectExpr("sum(size(values)) as n").first()["n"]
    assert values == 7**3
    assert len(report.exchanges(table)) == 1
    u = blocks.solve(g, frame(spark, random_field(g)), Kernel.CHAT_2)
    # points, then four between the axes, and the table's own one: it comes along in the third of the four
    assert len(report.exchanges(u)) == 6 and all("hashpartitioning" in e for e in report.exchanges(u))
    assert "Join" not in u._jdf.queryExecution().executedPlan().toString()


def test_line_that_needs_no_table(spark):
    assert blocks.green_blocks(spark, GridSpec.of("443333", 4), Kernel.HEJ_4) is None
    assert blocks.green_blocks(spark, GridSpec.of("001133", 4), Kernel.HEJ_4) is None


@pytest.mark.parametrize("code,center", list(itertools.product(["444433", "044433", "333344"], Center)))
def test_tiles_partition_each_axis(code, center):
    g = GridSpec.of(code, 7, center)
    for slabs in (False, True):
        plan = blocks.BlockPlan(g, slabs, 60)
        for done in range(len(plan.groups) + 1):
            t = plan.tiling(done)
            for d in range(3):
                parts = [t.members(d, k) for k in range(t.tiles(d))]
                assert sorted(np.concatenate(parts).tolist()) == list(range(t.extent[d]))
                for k, p in enumerate(parts):
                    assert (np.diff(p) > 0).all() and (t.folded(d, p) // t.size[d] == k).all()


def test_metrics_of_the_run_itself(spark):
    g = GridSpec.of("333333", 8)
    u = FieldSolver(spark, g, strategy="slab").solve(frame(spark, random_field(g)))
    assert all(r[2] == 0 for r in report.metrics(u))
    u.collect()
    rows = report.metrics(u)
    assert [r[0] for r in rows] == list(range(len(rows)))
    exchanged = [r for r in rows if r[1] == "Exchange"]
    assert len(exchanged) == 3 and exchanged[0][2] == 512 and all(r[3] > 0 and r[4] > 0 for r in exchanged)
    steps = [r for r in rows if r[1] == "MapInArrow"]
    assert steps[-1][2] == 512 and all(r[5] > 0 for r in steps)
