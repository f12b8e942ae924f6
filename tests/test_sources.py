import numpy as np

from gridloom.operators import analysis, dense
from gridloom.plans.spec import Center, Diff, Equation, GridSpec, Kernel
from gridloom.solver import FieldSolver
from gridloom.sources import files
from gridloom.functions import special
from gridloom.sources.generate import field_frame, gaussian_blob, shear_waves, vortex_tube, wall_waves
from gridloom.streaming.solve import solve_stream


def test_field_files(spark, tmp_path):
    g = GridSpec.of("333333", 4, components=3)
    f = field_frame(spark, g)
    files.write_field(f, str(tmp_path / "f"))
    back = files.read_field(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, back.select(f.columns).collect())) == sorted(map(tuple, f.collect()))
    files.write_field(f, str(tmp_path / "s"), single=True)
    assert files.read_field(spark, str(tmp_path / "s")).count() == 192
    assert 'AttributeType="Vector"' in files.descriptor(g, "u", "u.parquet", 3)
    assert "conf" in files.provenance(spark)


def test_raw_table(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(2, 3, 4))  # slowest axis first
    x.astype("<f8").tofile(tmp_path / "t.ker")
    got = {(r["i0"], r["i1"], r["i2"]): r["v"] for r in files.read_raw(spark, str(tmp_path / "t.ker"), (4, 3, 2)).collect()}
    assert all(got[i, j, k] == x[k, j, i] for k, j, i in np.ndindex(2, 3, 4))


def test_vortex_tube_velocity(spark):
    """The velocity of a tube in free space, from its vorticity."""
    g = GridSpec.of("444433", (24, 24, 2), Center.CELL, (1.0, 1.0, 1 / 12), 3)
    w, u = (vortex_tube(spark, g, 2, 0.08, which=k) for k in ("rhs", "solution"))
    s = FieldSolver(spark, g, Kernel.CHAT_2, Equation.ROT, Diff.FD2, strategy="local")
    e = {r["comp"]: r["err_inf"] for r in analysis.error_norms(s.solve(w), u, g).collect()}
    top = u.agg({"v": "max"}).first()[0]
    assert max(e.values()) < 0.1 * top


def test_stream(spark, tmp_path):
    g = GridSpec.of("333333", 4)
    f = field_frame(spark, g)
    f.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = solve_stream(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in")), FieldSolver(spark, g), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    got = np.zeros((1, 4, 4, 4))
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got[0, r["i0"], r["i1"], r["i2"]] = r["v"]
    want = np.zeros((1, 4, 4, 4))
    for r in f.collect():
        want[0, r["i0"], r["i1"], r["i2"]] = r["v"]
    assert np.allclose(got, dense.solve(g, want, Kernel.CHAT_2), atol=1e-12)


def test_gaussian_blob(spark):
    g = GridSpec.of("444444", 24)
    rhs, exact = (gaussian_blob(spark, g, 0.1, which=k) for k in ("rhs", "solution"))
    e = analysis.error_norms(FieldSolver(spark, g, Kernel.LGF_4, strategy="local").solve(rhs), exact, g).first()
    assert e["err_inf"] < 0.01 * abs(exact.agg({"v": "min"}).first()[0])


def test_rotational_fields(spark):
    g = GridSpec.of("333333", 8, components=3)
    s = FieldSolver(spark, g, Kernel.CHAT_2, Equation.ROT, Diff.SPE, strategy="slab")
    assert analysis.error_norms(s.solve(shear_waves(spark, g)), shear_waves(spark, g, "solution"), g).agg({"err_inf": "max"}).first()[0] < 1e-12
    odd, even, free = (1, 1), (0, 0), (3, 3)
    g = GridSpec((8, 8, 8), ((even, odd, free), (odd, even, free), (odd, odd, free)), components=3)
    s = FieldSolver(spark, g, Kernel.CHAT_2, Equation.ROT, Diff.SPE, strategy="pencil")
    assert analysis.error_norms(s.solve(wall_waves(spark, g)), wall_waves(spark, g, "solution"), g).agg({"err_inf": "max"}).first()[0] < 1e-12


def test_integrals_and_bessel():
    # fixed values of public tables
    assert np.allclose(special.en(2, [0.5, 1.0]), [0.3266438624, 0.1484955068], rtol=1e-9)
    assert np.allclose(special.bessel_i(0, [0.0, 1.0, 3.0]), [1.0, 1.2660658778, 4.8807925859], rtol=1e-9)
    assert np.allclose(special.bessel_i(1, [0.0, 1.0, 3.0]), [0.0, 0.5651591040, 3.9533702174], rtol=1e-9)


def test_convergence_report(spark):
    rows = [("a", 8, 0.4), ("a", 16, 0.1), ("b", 8, 1.0), ("b", 16, 0.5)]
    got = analysis.convergence(spark.createDataFrame(rows, "kernel string, n int, err double")).where("n = 16").collect()
    assert {r["kernel"]: round(r["order"], 9) for r in got} == {"a": 2.0, "b": 1.0}
