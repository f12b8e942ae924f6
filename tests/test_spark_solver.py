import numpy as np
import pytest

from gridloom.functions import fields
from gridloom.operators import analysis, dense, multiply
from gridloom.plans.spec import Center, Diff, Equation, GridSpec, Kernel
from gridloom.solver import FieldSolver
from gridloom.sources.generate import field_frame


def as_array(df, grid, rhs=0):
    out = np.zeros((grid.components, *grid.shape))
    for r in df.where(f"rhs_id = {rhs}").collect():
        out[r["comp"], r["i0"], r["i1"], r["i2"]] = r["v"]
    return out


def frame(spark, f, rhs=0):
    rows = [(rhs, int(c), int(i), int(j), int(k), float(v)) for (c, i, j, k), v in np.ndenumerate(f)]
    return spark.createDataFrame(rows, "rhs_id long, comp int, i0 int, i1 int, i2 int, v double")


@pytest.mark.parametrize("strategy", ["local", "slab", "pencil"])
@pytest.mark.parametrize("code,center", [("333333", Center.CELL), ("044433", Center.CELL), ("444444", Center.NODE), ("013399", Center.NODE)])
def test_strategies_agree_with_the_dense_solve(spark, strategy, code, center):
    g = GridSpec.of(code, (4, 4, 1) if code.endswith("99") else 4, center)
    f = np.random.default_rng(3).normal(size=(1, *g.shape))
    with FieldSolver(spark, g, Kernel.CHAT_2, strategy=strategy) as s:
        u = as_array(s.solve(frame(spark, f)), g)
    assert np.allclose(u, dense.solve(g, f, Kernel.CHAT_2), atol=1e-12)


@pytest.mark.parametrize("strategy", ["local", "slab"])
def test_rotational(spark, strategy):
    g = GridSpec.of("333344", 4, components=3)
    f = np.random.default_rng(4).normal(size=(3, *g.shape))
    with FieldSolver(spark, g, Kernel.CHAT_2, Equation.ROT, Diff.FD4, strategy=strategy) as s:
        u = as_array(s.solve(frame(spark, f)), g)
    assert np.allclose(u, dense.solve(g, f, Kernel.CHAT_2, Equation.ROT, Diff.FD4), atol=1e-12)


def test_missing_points_read_as_zero(spark):
    g = GridSpec.of("333333", 4)
    f = np.zeros((1, 4, 4, 4))
    f[0, 1, 2, 3] = 1.0
    one = spark.createDataFrame([(1, 2, 3, 1.0)], "i0 int, i1 int, i2 int, v double")
    for strategy in ("local", "pencil"):
        u = as_array(FieldSolver(spark, g, strategy=strategy).solve(one), g)
        assert np.allclose(u, dense.solve(g, f, Kernel.CHAT_2), atol=1e-12)


def test_many_right_hand_sides(spark):
    g = GridSpec.of("003333", 4)
    a, b = np.random.default_rng(5).normal(size=(2, 1, *g.shape))
    df = frame(spark, a, 0).union(frame(spark, b, 7))
    u = FieldSolver(spark, g, strategy="pencil").solve(df).cache()
    assert np.allclose(as_array(u, g, 0), dense.solve(g, a, Kernel.CHAT_2), atol=1e-12)
    assert np.allclose(as_array(u, g, 7), dense.solve(g, b, Kernel.CHAT_2), atol=1e-12)


@pytest.mark.parametrize("kernel", [Kernel.LGF_4, Kernel.HEJ_6, Kernel.MEHR_6F])
@pytest.mark.parametrize("code", ["333333", "013300", "344433", "444433"])
def test_green_table(spark, kernel, code):
    if code == "344433":
        code = "443333"
    g = GridSpec.of(code, 4)
    want = dense.green(g, kernel)
    got = np.zeros(g.modes)
    for r in multiply.green_table(spark, g, kernel).collect():
        got[r["i0"], r["i1"], r["i2"]] = r["g"]
    assert np.allclose(got, want, atol=1e-12)


def test_spectral_filter_and_norms(spark):
    g = GridSpec.of("333333", 8)
    rhs, exact = field_frame(spark, g, "rhs"), field_frame(spark, g, "solution")
    s = FieldSolver(spark, g, strategy="pencil")
    e = analysis.error_norms(s.solve(rhs), exact, g).first()
    assert e["err_l2"] < 1e-12 and e["err_inf"] < 1e-12
    gone = s.solve(rhs, spectral=lambda k0, k1, k2, re, im: (re * 0, im * 0))
    assert analysis.summary(gone, g).first()["v_max"] == 0


def test_generated_field_is_the_manufactured_one(spark):
    g = GridSpec.of("044199", (4, 4, 1))
    x = np.meshgrid(*[(np.arange(p.n) + 0.5) * p.h for p in g.axes], indexing="ij")
    want = fields.manufactured(g, x, np)[0]
    assert np.allclose(as_array(field_frame(spark, g, "rhs"), g)[0], want, atol=1e-12)


@pytest.mark.parametrize("code,center", [("001101", Center.CELL), ("330010", Center.NODE), ("113333", Center.CELL), ("000000", Center.NODE)])
def test_there_and_back_in_one_pass(spark, code, center):
    """The last axis is transformed, multiplied and transformed back on the same lines: one exchange for each other way."""
    g = GridSpec.of(code, 4, center)
    f = np.random.default_rng(8).normal(size=(1, *g.shape))
    for strategy, exchanges in (("pencil", 5), ("slab", 3)):
        out = FieldSolver(spark, g, Kernel.HEJ_4, strategy=strategy).solve(frame(spark, f))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == exchanges
        assert np.allclose(as_array(out, g), dense.solve(g, f, Kernel.HEJ_4), atol=1e-12)


def test_box_and_shift(spark):
    from gridloom.operators import layout

    df = layout.index_table(spark, (4, 3, 2)).withColumn("v", layout.collapsed((4, 3, 2), *(layout.F.col(a) for a in layout.AXES)))
    got = {(r["i0"], r["i1"], r["i2"]): r["v"] for r in layout.shift(layout.box(df, (1, 0, 1), (2, 1, 1)), (-1, 5, 0)).collect()}
    assert got == {(i - 1, j + 5, 1): i + 4 * (j + 3) for i in (1, 2) for j in (0, 1)}
    assert layout.box(df, (3, 0, 0), (2, 9, 9)).count() == 0


def test_relative_error(spark):
    g = GridSpec.of("333333", 3)
    f = field_frame(spark, g)
    double = f.withColumn("v", f.v * 2)
    assert analysis.relative_error(double, f).first()["rel_l2"] == pytest.approx(1.0)
    assert analysis.relative_error(f, f).first()["rel_l2"] == 0.0


def test_gathered_lines_need_no_exchange(spark):
    from gridloom.operators import layout

    g = GridSpec.of("003311", 4)
    f = np.random.default_rng(9).normal(size=(1, *g.shape))
    s = FieldSolver(spark, g, strategy="pencil")
    lines = layout.to_lines(layout.normalise(frame(spark, f)), g.order[0])
    assert np.allclose(as_array(s.solve(lines), g), dense.solve(g, f, Kernel.CHAT_2), atol=1e-12)
    stored = spark.createDataFrame(lines.collect(), lines.schema)
    assert s.forward(stored)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    with pytest.raises(ValueError):
        FieldSolver(spark, g, strategy="slab").forward(lines)


def test_not_a_number_is_refused_where_asked(spark):
    g = GridSpec.of("333333", 4)
    df = spark.createDataFrame([(0, 0, 0, float("nan")), (1, 0, 0, 1.0)], "i0 int, i1 int, i2 int, v double")
    with pytest.raises(Exception, match="holds NaN"):
        FieldSolver(spark, g).solve(df, check=True).collect()
    assert FieldSolver(spark, g).solve(df.where("i0 = 1"), check=True).count() == 64
    empty = spark.createDataFrame([(0, 0, 0, None)], "i0 int, i1 int, i2 int, v double")
    for strategy in ("local", "pencil"):
        with pytest.raises(Exception, match="or null"):
            FieldSolver(spark, g, strategy=strategy).solve(empty, check=True).collect()
        assert FieldSolver(spark, g, strategy=strategy).solve(empty).count() == 64


def test_profile_and_exchanges(spark):
    from gridloom.operators import report

    g = GridSpec.of("443333", 4)
    with FieldSolver(spark, g, strategy="pencil") as s:
        rows = {r["stage"]: r for r in report.profile(s, field_frame(spark, g)).collect()}
        assert list(rows) == ["input", "green", "forward", "multiply", "backward"] and rows["backward"]["rows"] == 64
        assert rows["forward"]["exchanges"] == 3 and all(r["seconds"] > 0 for r in rows.values())
    assert report.exchanges(field_frame(spark, g)) == []


def test_gaussian_along_one_axis(spark):
    from gridloom.sources.generate import gaussian_line

    g = GridSpec.of("443333", (32, 2, 2))
    u = FieldSolver(spark, g, Kernel.CHAT_2).solve(gaussian_line(spark, g, sigma=0.08))
    e = analysis.error_norms(u, gaussian_line(spark, g, sigma=0.08, which="solution"), g).first()
    assert e["err_inf"] < 0.02


def test_show(spark, capsys):
    from gridloom.sources import files

    files.show(field_frame(spark, GridSpec.of("333333", 2)), 3)
    out = capsys.readouterr().out
    assert "rhs_id" in out and "only showing top 3 rows" in out
