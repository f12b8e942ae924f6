"""Solves of the gridded table with every kernel and at node centres, each with SQL that goes another way: the kernel as
a sum over wave numbers for the regularised kernels (which converge geometrically) or as an integral over heat kernels
for the lattice ones, then the sum over all sources; stencils that give the source back; expansions in eigenfunctions
and images."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom import queries as Q
from gridloom.functions import special as S
from gridloom.functions.farfield import far
from gridloom.operators import analysis, layout
from gridloom.operators.layout import AXES
from gridloom.plans.spec import Center, Diff, Equation, GridSpec, Kernel
from gridloom.solver import FieldSolver
from gridloom.sources.generate import field_frame, gaussian_blob, gaussian_line, shear_waves, vortex_tube, wall_waves
from gridloom.sources.gridded import lineitem_grid
from gridloom.sources.library import GreenLibrary

N, H, EPS = Q.N, 1 / Q.N, 2 / Q.N
HEJ = (Kernel.HEJ_2, Kernel.HEJ_4, Kernel.HEJ_6, Kernel.HEJ_8, Kernel.HEJ_10)
LATTICE = tuple(k for k in Kernel if k.family in ("LGF", "MEHR"))
GAMMA = "0.5772156649015329::DOUBLE"

# -- regularised kernels ----------------------------------------------------------------------


def _filter(kernel: Kernel, k2: str) -> str:
    """Transform of the regularised source at squared wave number ``k2``."""
    q = f"({k2} * {EPS * EPS!r}::DOUBLE)"
    terms = " + ".join(f"pow({q}, {i}) / {f}" for i, f in list(enumerate((1, 2, 8, 48, 384)))[: kernel.order // 2])
    return f"({terms}) * exp(-{q} / 2)"


def _radial(kernel: Kernel) -> str:
    """CTE ``radial(d2, g)``: three unbounded axes, at squared offsets d2, as a sum over wave numbers."""
    offsets = "d AS (SELECT DISTINCT a * a + b * b + c * c AS d2 FROM range(17) x(a), range(17) y(b), range(17) z(c) WHERE a <= 8 AND b <= 8 AND c <= 8)"
    wave = f"CASE WHEN d2 = 0 OR j = 0 THEN 1.0::DOUBLE ELSE sin(x * r) / (CASE WHEN d2 = 0 OR j = 0 THEN 1 ELSE x * r END) END"
    if kernel == Kernel.HEJ_0:  # all waves up to the grid's, none beyond: Simpson's rule
        top = math.pi / H
        weight = "CASE WHEN j = 0 OR j = 1200 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
        points = f"SELECT d2, j, {top / 1200!r}::DOUBLE * j AS x, {H!r}::DOUBLE * sqrt(d2) AS r FROM d, range(1201) t(j)"
        return f"{offsets}, radial AS (SELECT d2, -sum({weight} * {wave}) * {top / 3600!r}::DOUBLE / (2 * pi() * pi()) AS g FROM ({points}) GROUP BY d2)"
    points = f"SELECT d2, j, 0.8::DOUBLE * j AS x, {H!r}::DOUBLE * sqrt(d2) AS r FROM d, range(80) t(j)"
    return f"{offsets}, radial AS (SELECT d2, -sum(CASE WHEN j = 0 THEN 0.5 ELSE 1 END * {_filter(kernel, 'x * x')} * {wave}) * 0.8::DOUBLE / (2 * pi() * pi()) AS g FROM ({points}) GROUP BY d2)"


def _planar(kernel: Kernel) -> str:
    """CTE ``planar(d2, g)``: two unbounded axes without a third wave number."""
    offsets = "d AS (SELECT DISTINCT a * a + b * b AS d2 FROM range(17) x(a), range(9) y(b))"
    if kernel == Kernel.HEJ_0:  # the integral of (1 - J0) / s, with J0 as a mean of cosines
        rho = "(pi() * sqrt(d2))"
        weight = "CASE WHEN j = 0 OR j = 1200 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
        mean = f"list_sum(list_transform(range(96), lambda m: cos({rho} * s * sin(pi() * (m + 0.5::DOUBLE) / 96)))) / 96"
        inner = f"SELECT d2, sum({weight} * CASE WHEN j = 0 OR d2 = 0 THEN 0 ELSE (1 - {mean}) / s END) / 3600 AS c FROM (SELECT d2, j, j / 1200.0::DOUBLE AS s FROM d, range(1201) t(j)) GROUP BY d2"
        near = f"(c + ln({2 * H / math.pi!r}::DOUBLE) - {GAMMA}) / (2 * pi())"
        return f"{offsets}, planar AS (SELECT d2, CASE WHEN {rho} < 30 THEN {near} ELSE ln({H!r}::DOUBLE * sqrt(d2)) / (2 * pi()) END AS g FROM ({inner}))"
    coefficients = {2: (), 4: (1 / 2,), 6: (3 / 4, -1 / 8), 8: (11 / 12, -7 / 24, 1 / 48), 10: (25 / 24, -23 / 48, 13 / 192, -1 / 384)}[kernel.order]
    t = f"({H * H / EPS / EPS / 2!r}::DOUBLE * d2)"
    poly = " + ".join(f"({c!r}::DOUBLE) * pow(2 * {t}, {i})" for i, c in enumerate(coefficients)) or "0"
    # the entire part of the exponential integral, as a series of positive terms
    ein = f"exp(-{t}) * sum(pow({t}, k) / gamma(k + 1) * harmonic)"
    series = "hk AS (SELECT k, sum(1.0::DOUBLE / k) OVER (ORDER BY k) AS harmonic FROM range(1, 160) t(k))"
    return f"{offsets}, {series}, planar AS (SELECT d2, (0.5 * {ein} + ln({EPS!r}::DOUBLE) + ln(2) / 2 - {GAMMA} / 2 - ({poly}) * exp(-{t})) / (2 * pi()) AS g FROM d, hk GROUP BY d2)"


def _even(x: str, n: int, points: str) -> str:
    """Weight of point ``x`` in mode ``points`` of an even periodic line of 2n points, folded to n + 1."""
    return f"CASE WHEN {x} IN (0, {n}) THEN 1 ELSE 2 END * cos(pi() * {x} * {points} / {n})"


def _spectral(kernel: Kernel) -> str:
    return Q._green_sql(kernel, H)


def _solved(code: str, kernel: Kernel, strategy: str, digits: int = 3):
    """The gridded table, solved by blocks ("pencil", "slab") or by rows with a joined table ("rows")."""
    flat = code.endswith("99")

    def run(spark, sf):
        f = Q._gridded(spark, sf)
        if flat:
            f = f.groupBy("i0", "i1").agg(F.sum("v").alias("v")).withColumn("i2", F.lit(0))
        s = FieldSolver(spark, GridSpec.of(code, (N, N, 1) if flat else N), kernel, strategy="slab" if strategy == "rows" else strategy, keep_green=False)
        u = s.backward(s.multiply(s.forward(f))) if strategy == "rows" else s.solve(f)
        return u.select(*AXES, Q._round("v", digits).alias("v"))

    return run


_POINTS = f"p AS (SELECT a, b, c FROM range({N}) x(a), range({N}) y(b), range({N}) z(c))"
_PLANE = f"p AS (SELECT a, b, 0 AS c FROM range({N}) x(a), range({N}) y(b))"


def _free_sql(kernel: Kernel, digits: int = 3) -> str:
    """Three unbounded axes: the sum over all sources."""
    if kernel in LATTICE:
        table, at = _near_sql(kernel, 3, 8), "x = abs(a - i0) AND y = abs(b - i1) AND z = abs(c - i2)"
    else:
        table, at = _radial(kernel), "d2 = (a - i0) * (a - i0) + (b - i1) * (b - i1) + (c - i2) * (c - i2)"
    value = Q._sql_round(f"sum(f.v * {H ** 3!r}::DOUBLE * g)", digits)
    return f"WITH {table}, f AS ({Q._lineitem_sql()}), {_POINTS} SELECT {Q._INDEX}, {value} AS v FROM p, f JOIN {'near' if kernel in LATTICE else 'radial'} k ON {at} GROUP BY a, b, c"


def _planar_sql(kernel: Kernel) -> tuple[str, str, str]:
    """Table of the plane's kernel, its name, and its join to offsets ox, oy."""
    if kernel in LATTICE:
        return _near_sql(kernel, 2, 16), "near", "x = abs(ox) AND y = abs(oy)"
    return _planar(kernel), "planar", "d2 = ox * ox + oy * oy"


def _plane_sql(kernel: Kernel) -> str:
    """A wall of even symmetry and an unbounded side, and an unbounded axis: sources and their images."""
    table, name, at = _planar_sql(kernel)
    sources = f"f AS (SELECT i0, i1, sum(v) AS v FROM ({Q._lineitem_sql()}) GROUP BY ALL), s AS (SELECT * FROM f UNION ALL SELECT -1 - i0, i1, v FROM f)"
    pairs = "SELECT a, b, c, s.v AS v, a - i0 AS ox, b - i1 AS oy FROM p, s"
    return f"WITH {table}, {sources}, {_PLANE} SELECT {Q._INDEX}, {Q._sql_round(f'sum(d.v * {H * H!r}::DOUBLE * g)', 3)} AS v FROM ({pairs}) d JOIN {name} ON {at} GROUP BY a, b, c"


def _mixed_sql(kernel: Kernel) -> str:
    """Two unbounded axes and a periodic one: the plane's kernel at its mode 0, the spectral form at the others, turned
    into a kernel of offsets by cosine sums."""
    table, name, at = _planar_sql(kernel)
    s0 = f"s0 AS (SELECT m AS a, ty AS b, sum(g * {_even('tx', 8, 'm')}) AS v FROM (SELECT ox AS tx, oy AS ty, g FROM range(9) i(ox), range(9) j(oy) JOIN {name} ON {at}), range(16) t(m) GROUP BY m, ty)"
    s1 = f"s1 AS (SELECT a, m AS b, sum(v * {_even('b', 8, 'm')}) * {H * H!r}::DOUBLE AS v FROM s0, range(16) t(m) GROUP BY a, m)"
    k = [f"pi() * CASE WHEN {x} > 8 THEN {x} - 16 ELSE {x} END AS k{d}" for d, x in enumerate("ab")]
    waves = f"SELECT a, b, c, v, {k[0]}, {k[1]}, 2 * pi() * greatest(c, 0.25::DOUBLE) AS k2 FROM s1, range(5) z(c)"
    t = f"t AS (SELECT a, b, c, CASE WHEN c = 0 THEN v ELSE {_spectral(kernel)} END AS g FROM ({waves}))"
    q0 = "q0 AS (SELECT a, b, oz, sum(CASE WHEN c IN (0, 4) THEN 1 ELSE 2 END * g * cos(2 * pi() * c * oz / 8)) / 8 AS g FROM t, range(8) r(oz) GROUP BY a, b, oz)"
    q1 = "q1 AS (SELECT a, oy, oz, sum(g * cos(2 * pi() * b * oy / 16)) / 16 AS g FROM q0, range(8) r(oy) GROUP BY a, oy, oz)"
    q2 = "q2 AS (SELECT ox, oy, oz, sum(g * cos(2 * pi() * a * ox / 16)) / 16 AS g FROM q1, range(8) r(ox) GROUP BY ox, oy, oz)"
    where = f"ox = abs(a - i0) AND oy = abs(b - i1) AND oz = (c - i2 + {N}) % {N}"
    return f"WITH {table}, {s0}, {s1}, {t}, {q0}, {q1}, {q2}, f AS ({Q._lineitem_sql()}), {_POINTS} SELECT {Q._INDEX}, {Q._sql_round('sum(f.v * g)', 3)} AS v FROM p, f JOIN q2 ON {where} GROUP BY a, b, c"


def _line_table(kernel: Kernel) -> str:
    """CTE ``s(n, p, q, g)``: one unbounded axis, at offset n for modes p of a periodic axis and q of one between even walls."""
    modes = f"range({N + 1}) x(n), range({N // 2 + 1}) y(p), range({N + 1}) z(q)"
    if kernel == Kernel.CHAT_2:
        return f"s AS (SELECT n, p, q, CASE WHEN k = 0 THEN r / 2 ELSE -exp(-k * r) / (2 * CASE WHEN k = 0 THEN 1 ELSE k END) END AS g FROM (SELECT n, p, q, {H!r}::DOUBLE * n AS r, sqrt(pow(2 * pi() * p, 2) + pow(pi() * q, 2)) AS k FROM {modes}))"
    if kernel == Kernel.LGF_2:
        root = f"SELECT *, 1 / (1 + c / 2 + sqrt(c * c / 4 + c)) AS r FROM (SELECT n, p, q, 4 * pow(sin(pi() * p * {H!r}::DOUBLE), 2) + 4 * pow(sin(pi() * q * {H / 2!r}::DOUBLE), 2) AS c FROM {modes})"
        return f"s AS (SELECT n, p, q, {H!r}::DOUBLE * CASE WHEN c = 0 THEN n / 2.0::DOUBLE ELSE -pow(r, n) / (1 / r - CASE WHEN c = 0 THEN 0 ELSE r END) END AS g FROM ({root}))"
    if kernel == Kernel.MEHR_4L:
        y = f"SELECT n, p, q, pow(sin(pi() * p * {H!r}::DOUBLE), 2) AS y0, pow(sin(pi() * q * {H / 2!r}::DOUBLE), 2) AS y1 FROM {modes}"
        pole = f"SELECT n, p, q, 2 + 8 * (y0 + y1 - y0 * y1) / 3 AS a0, 2 * (y0 + y1) / 3 - 1 AS a1 FROM ({y})"
        root = f"SELECT *, CASE WHEN a1 > 0 AND n % 2 = 0 THEN -1 ELSE 1 END AS sgn, 1 / (abs(a0 / (2 * a1)) + sqrt(greatest(pow(a0 / (2 * a1), 2) - 1, 0))) AS r FROM ({pole})"
        value = "CASE WHEN p = 0 AND q = 0 THEN n / 2.0::DOUBLE WHEN abs(a1) < 1e-12 THEN CASE WHEN n = 0 THEN -1 / a0 ELSE 0 END ELSE -sgn * pow(r, n + 1) / (a1 * (r * r - 1)) END"
        return f"s AS (SELECT n, p, q, {H!r}::DOUBLE * {value} AS g FROM ({root}))"
    points = f"SELECT n, p, q, j, 0.4::DOUBLE * j AS x, {H!r}::DOUBLE * n AS r, pow(2 * pi() * p, 2) + pow(pi() * q, 2) AS k2 FROM {modes}, range(140) t(j)"
    moving = f"-2 * {_filter(kernel, '(k2 + x * x)')} * cos(x * r) / CASE WHEN k2 + x * x = 0 THEN 1 ELSE k2 + x * x END"
    still = f"CASE WHEN j = 0 THEN r * r ELSE 2 * (1 - cos(x * r)) / CASE WHEN j = 0 THEN 1 ELSE x * x END END * {_filter(kernel, '(x * x)')}"
    return f"s AS (SELECT n, p, q, sum(CASE WHEN j = 0 THEN 0.5 ELSE 1 END * CASE WHEN k2 = 0 THEN {still} ELSE {moving} END) * 0.4::DOUBLE / (2 * pi()) AS g FROM ({points}) GROUP BY n, p, q)"


def _line_sql(kernel: Kernel) -> str:
    """One unbounded axis: expansions along the others, the sum over sources along it at each pair of modes."""
    expand = "c1 AS (SELECT i0, m AS m1, i2, sum(v * w) AS v FROM f JOIN b1 ON i1 = i GROUP BY ALL), c2 AS (SELECT i0, m1, m AS m2, sum(v * w) AS v FROM c1 JOIN b2 ON i2 = i GROUP BY ALL)"
    norms = "n1 AS (SELECT DISTINCT m AS m1, s AS s1 FROM b1), n2 AS (SELECT DISTINCT m AS m2, s AS s2 FROM b2)"
    mode = f"CASE WHEN m1 > {N} THEN m1 - {N} ELSE m1 END"
    u = f"u AS (SELECT a, m1, m2, sum(v * s1 * s2 * {H!r}::DOUBLE * g) AS v FROM c2 JOIN n1 USING (m1) JOIN n2 USING (m2), range({N}) x(a) JOIN s ON n = abs(a - i0) AND p = {mode} AND q = m2 GROUP BY a, m1, m2)"
    back = "d1 AS (SELECT a, m1, i AS c, sum(v * w) AS v FROM u JOIN b2 ON m2 = m GROUP BY ALL), d0 AS (SELECT a, i AS b, c, sum(v * w) AS v FROM d1 JOIN b1 ON m1 = m GROUP BY ALL)"
    return f"WITH {_line_table(kernel)}, f AS ({Q._lineitem_sql()}), b1 AS ({Q._basis_sql(3, 3, N)}), b2 AS ({Q._basis_sql(0, 0, N)}), {expand}, {norms}, {u}, {back} SELECT {Q._INDEX}, {Q._sql_round('v', 3)} AS v FROM d0"


def _bessel_sql() -> str:
    """Two unbounded axes and a periodic one, singular kernel: modified Bessel functions by a sum that converges
    geometrically, at each mode of an expansion along the periodic axis."""
    at = f"SELECT DISTINCT x * x + y * y AS d2, c FROM range({N}) i(x), range({N}) j(y), range({N // 2 + 1}) z(c)"
    req = f"({H!r}::DOUBLE / sqrt(pi()))"
    arg = f"2 * pi() * c * CASE WHEN d2 = 0 THEN {req} ELSE {H!r}::DOUBLE * sqrt(d2) END"
    sums = f"SELECT d2, c, {arg} AS x, sum(CASE WHEN j = 0 THEN 0.5 ELSE 1 END * exp(-least(({arg}) * cosh(j / 16.0::DOUBLE), 700)) * CASE WHEN d2 = 0 THEN cosh(j / 16.0::DOUBLE) ELSE 1 END) / 16 AS bessel FROM ({at}), range(240) t(j) GROUP BY d2, c"
    still = f"CASE WHEN d2 = 0 THEN (pi() - 6 + 2 * ln(0.5 * pi() * pow({req}, 2))) / (8 * pi()) ELSE ln({H!r}::DOUBLE * sqrt(greatest(d2, 1))) / (2 * pi()) END"
    moving = "CASE WHEN d2 = 0 THEN -(1 - x * bessel) / (pi() * greatest(x * x, 1e-30)) ELSE -bessel / (2 * pi()) END"
    table = f"t AS (SELECT d2, c AS q, CASE WHEN c = 0 THEN {still} ELSE {moving} END AS g FROM ({sums}))"
    expand = "c2 AS (SELECT i0, i1, m, sum(v * w) * any_value(s) AS v FROM f JOIN b2 ON i2 = i GROUP BY ALL)"
    mode = f"CASE WHEN m > {N} THEN m - {N} ELSE m END"
    u = f"u AS (SELECT a, b, m AS m2, sum(v * {H * H!r}::DOUBLE * g) AS v FROM c2, range({N}) x(a), range({N}) y(b) JOIN t ON d2 = (a - i0) * (a - i0) + (b - i1) * (b - i1) AND q = {mode} GROUP BY a, b, m)"
    back = "d0 AS (SELECT a, b, i AS c, sum(v * w) AS v FROM u JOIN b2 ON m2 = m GROUP BY ALL)"
    return f"WITH {table}, f AS ({Q._lineitem_sql()}), b2 AS ({Q._basis_sql(3, 3, N)}), {expand}, {u}, {back} SELECT {Q._INDEX}, {Q._sql_round('v', 3)} AS v FROM d0"


def _log_sql() -> str:
    """The singular kernel of the plane, with images."""
    origin = f"(pi() - 6 + 2 * ln(0.5 * {H * H!r}::DOUBLE)) / (8 * pi())"
    table = f"planar AS (SELECT DISTINCT x * x + y * y AS d2, CASE WHEN x + y = 0 THEN {origin} ELSE ln({H!r}::DOUBLE * sqrt(greatest(x * x + y * y, 1))) / (2 * pi()) END AS g FROM range(17) i(x), range(9) j(y))"
    return _plane_sql(Kernel.HEJ_2).replace(_planar(Kernel.HEJ_2), table)


# -- lattice kernels: the stencil of the kernel's operator turns it into that of its source --------


def _stencils(kernel: Kernel, axes: int) -> tuple[dict, dict]:
    """Weights by offset of the operator and of the source."""
    delta = {(0,) * axes: 1.0}

    def times(a: dict, b: dict) -> dict:
        out: dict = {}
        for (x, v), (y, w) in itertools.product(a.items(), b.items()):
            k = tuple(i + j for i, j in zip(x, y))
            out[k] = out.get(k, 0.0) + v * w
        return out

    def plus(*parts: tuple[float, dict]) -> dict:
        out: dict = {}
        for f, a in parts:
            for k, v in a.items():
                out[k] = out.get(k, 0.0) + f * v
        return out

    def second(d: int, m: int) -> dict:  # minus the second difference over m spacings
        step = tuple(m * (k == d) for k in range(axes))
        return plus((2.0, delta), (-1.0, {step: 1.0}), (-1.0, {tuple(-s for s in step): 1.0}))

    if kernel.family == "LGF":
        return plus(*((c, second(d, m)) for d in range(axes) for m, c in enumerate(S.SECOND[kernel.order], 1))), delta
    y = [plus((0.25, second(d, 1))) for d in range(axes)]
    sums = plus(*((1.0, v) for v in y))
    pairs = plus((0.0, delta), *((1.0, times(a, b)) for a, b in itertools.combinations(y, 2)))
    operator = plus((4.0, sums), (-8 / 3, pairs))
    if kernel.order == 6 and axes == 3:
        operator = plus((1.0, operator), (32 / 15, times(times(y[0], y[1]), y[2])))
    if kernel == Kernel.MEHR_4F:
        return operator, plus((1.0, delta), (-1 / 3, sums))
    if kernel == Kernel.MEHR_6F:
        return operator, plus((1.0, delta), (-1 / 3, sums), (8 / 45, pairs), *((-1 / 15, times(v, v)) for v in y))
    return operator, delta


PAD = 4  # cells around the table's grid along unbounded axes, as far as stencils reach


def stencil(field, weights: dict, mirrored: tuple[int, ...] = (), periodic: tuple[int, ...] = (), n: int = N):
    """A symmetric stencil applied to a field of points: each point goes to all that it is a neighbour of.  ``mirrored`` axes
    have even walls, ``periodic`` ones repeat."""
    rows = field.select(*AXES, "v")
    for d in mirrored:
        images = F.array(F.col(AXES[d]), -1 - F.col(AXES[d]), 2 * n - 1 - F.col(AXES[d]))
        rows = rows.select(*(F.explode(images).alias(a) if a == AXES[d] else F.col(a) for a in AXES), "v")
    steps = F.array(*(F.struct(*(F.lit(x).alias(f"s{d}") for d, x in enumerate((*at, 0, 0)[:3])), F.lit(float(w)).alias("w")) for at, w in weights.items()))
    moved = rows.select(*AXES, "v", F.explode(steps).alias("s"))
    to = [F.pmod(F.col(a) + F.col(f"s.s{d}"), F.lit(n)) if d in periodic else F.col(a) + F.col(f"s.s{d}") for d, a in enumerate(AXES)]
    return moved.select(*(t.cast("int").alias(a) for t, a in zip(to, AXES)), (F.col("v") * F.col("s.w")).alias("v")).groupBy(*AXES).agg(F.sum("v").alias("v"))


def _residual(code: str, kernel: Kernel):
    """The operator's stencil applied to the solution of the gridded table gives the table back (or, for kernels with a
    stencil of their own on the source, that stencil of it).  Unbounded axes are longer than the table by what stencils reach."""
    axes = 2 if code.endswith("99") else 3
    free = [d for d in range(axes) if code[2 * d : 2 * d + 2] == "44"]
    n = tuple(N + 2 * PAD if d in free else N if d < axes else 1 for d in range(3))
    grid = GridSpec.of(code, n, length=tuple(x / N for x in n))
    operator, source = _stencils(kernel, axes)
    pad = tuple(PAD if d in free else 0 for d in range(3))
    # weights of such stencils have small denominators: scaled, so that no value is halfway between two rounded ones
    unit = 0.7390851332151607 if kernel in (Kernel.MEHR_4F, Kernel.MEHR_6F) else 1.0
    others = {"mirrored": tuple(d for d in range(axes) if code[2 * d : 2 * d + 2] == "00"), "periodic": tuple(d for d in range(axes) if code[2 * d : 2 * d + 2] == "33")}

    def run(spark, sf):
        f = Q._gridded(spark, sf)
        if axes == 2:
            f = f.groupBy("i0", "i1").agg(F.sum("v").alias("v")).withColumn("i2", F.lit(0))
        s = FieldSolver(spark, grid, kernel, strategy="slab", keep_green=False)
        u = s.solve(layout.shift(f, pad))
        back = layout.shift(layout.box(stencil(u, operator, **others), pad, tuple(p + (N if d < axes else 1) - 1 for d, p in enumerate(pad))), tuple(-p for p in pad))
        return back.select(*AXES, Q._round(F.col("v") * (-unit / H**2), 2).alias("v"))

    cells = "f AS (SELECT i0, i1, 0 AS i2, sum(v) AS v FROM (" + Q._lineitem_sql() + ") GROUP BY ALL)" if axes == 2 else f"f AS ({Q._lineitem_sql()})"
    points = _PLANE if axes == 2 else _POINTS
    weights = ", ".join(f"({', '.join(map(str, (*at, 0, 0)[:3]))}, {w!r}::DOUBLE)" for at, w in source.items() if w)
    move = lambda x, d: f"(({x} + s{d} + {N}) % {N})" if d in others["periodic"] else f"(CASE WHEN {x} + s{d} < 0 THEN -1 - {x} - s{d} WHEN {x} + s{d} >= {N} THEN {2 * N - 1} - {x} - s{d} ELSE {x} + s{d} END)" if d in others["mirrored"] else f"({x} + s{d})"
    join = " AND ".join(f"i{d} = {move(x, d)}" for d, x in enumerate("abc"))
    return run, f"WITH {cells}, {points}, w AS (SELECT * FROM (VALUES {weights}) t(s0, s1, s2, w)) SELECT {Q._INDEX}, {Q._sql_round(f'coalesce(sum(f.v * w.w), 0) * {unit!r}::DOUBLE', 2)} AS v FROM p CROSS JOIN w LEFT JOIN f ON {join} GROUP BY a, b, c"


def _far_field(kernel: Kernel):
    """The potential of the whole gridded table far beyond any lattice table, in units of that of its sum at the origin:
    there the lattice function is that of the continuum, and the table's own shape shows."""

    def run(spark, sf):
        f = Q._gridded(spark, sf).select(*AXES, "v", F.explode(F.array(*(F.lit(k * 10_000).cast("long") for k in range(1, 9)))).alias("r"))

        def apply(batches):
            for b in batches:
                r = np.asarray(b.column("r"), float)
                x = [m * r - np.asarray(b.column(a), float) for m, a in zip((1, 2, 2), AXES)]
                v = np.asarray(b.column("v"))
                yield pa.RecordBatch.from_arrays([b.column("r"), pa.array(far(kernel, *x) * 12 * math.pi * r * v), pa.array(v)], names=["r", "part", "v"])

        parts = f.mapInArrow(apply, "r long, part double, v double")
        return parts.groupBy("r").agg(Q._round(F.sum("part") / F.sum("v"), 9).alias("scaled"))

    distance = "sqrt(pow(r - i0, 2) + pow(2 * r - i1, 2) + pow(2 * r - i2, 2))"
    return run, f"WITH f AS ({Q._lineitem_sql()}) SELECT r, {Q._sql_round(f'sum(v * 3 * r / {distance}) / sum(v)', 9)} AS scaled FROM f, (SELECT id * 10000 AS r FROM range(1, 9) t(id)) GROUP BY r"


def _heat_sql(kernel: Kernel, axes: int, reach: int) -> str:
    """CTE ``near(x, y[, z], g)``: a separable lattice kernel as an integral over time of products of heat kernels of one
    axis each, by the trapezoidal rule in the logarithm of time."""
    symbol = " + ".join(f"4 * ({c!r}::DOUBLE) * pow(sin({m} * u / 2.0::DOUBLE), 2)" for m, c in enumerate(S.SECOND[kernel.order], 1))
    times = "time AS (SELECT i, exp(0.15::DOUBLE * i) AS t FROM range(-200, 320) r(i))"
    early = f"SELECT i, n, sum(exp(-t * ({symbol})) * cos(n * u)) / 96 AS w FROM (SELECT i, t, pi() * (p + 0.5::DOUBLE) / 96 AS u FROM time, range(96) r(p) WHERE t < 30), range({reach + 1}) q(n) GROUP BY i, n"
    late = f"SELECT i, n, sum(CASE WHEN u = 0 THEN 0.5 ELSE 1 END * exp(-t * ({symbol})) * cos(n * u)) * 0.2 / (pi() * sqrt(any_value(t))) AS w FROM (SELECT i, t, 0.2::DOUBLE * p / sqrt(t) AS u FROM time, range(46) r(p) WHERE t >= 30), range({reach + 1}) q(n) GROUP BY i, n"
    heat = f"heat AS ({early} UNION ALL {late})"
    if axes == 3:
        near = f"near AS (SELECT a.n AS x, b.n AS y, c.n AS z, -sum(0.15::DOUBLE * t * a.w * b.w * c.w) / {H!r}::DOUBLE AS g FROM time JOIN heat a USING (i) JOIN heat b USING (i) JOIN heat c USING (i) GROUP BY a.n, b.n, c.n)"
    else:
        near = "near AS (SELECT a.n AS x, b.n AS y, -sum(0.15::DOUBLE * t * (a.w * b.w - o.w * o.w)) AS g FROM time JOIN heat a USING (i) JOIN heat b USING (i) JOIN heat o USING (i) WHERE o.n = 0 AND b.n <= 8 GROUP BY a.n, b.n)"
    return f"{times}, {heat}, {near}"


def _compact_sql(kernel: Kernel, axes: int, reach: int) -> str:
    """The same for a compact stencil: its function along one axis in closed form, integrated over the wave numbers of the
    others by the doubly exponential rule."""
    nodes = "node AS (SELECT j, pi() / (1 + exp(-pi() * sinh(0.05::DOUBLE * j))) AS k, 0.05::DOUBLE * pi() * pi() * cosh(0.05::DOUBLE * j) * exp(-pi() * sinh(0.05::DOUBLE * j)) / pow(1 + exp(-pi() * sinh(0.05::DOUBLE * j)), 2) AS wt FROM range(-64, 65) r(j))"
    if axes == 3:
        at = "SELECT a.j AS j0, b.j AS j1, pow(sin(a.k / 2), 2) AS y0, pow(sin(b.k / 2), 2) AS y1 FROM node a, node b"
    else:
        at = "SELECT j AS j0, 0 AS j1, pow(sin(k / 2), 2) AS y0, 0.0::DOUBLE AS y1 FROM node"
    cross, product = ("0", "8 / 3.0::DOUBLE") if kernel.order == 4 else ("8 * y0 * y1 / 15", "1.6::DOUBLE")
    pole = f"SELECT *, 2 * (y0 + y1) / 3 - 1 - {cross} AS a1, 2 + 8 * (y0 + y1) / 3 - {product} * y0 * y1 AS a0, 4 * (y0 + y1) - 8 * y0 * y1 / 3 AS rest FROM ({at})"
    gap = f"SELECT *, CASE WHEN abs(a1) < 1e-13 THEN 1 WHEN a1 < 0 THEN rest / (-2 * a1) ELSE a0 / (2 * a1) - 1 END AS d FROM ({pole})"
    left = f"SELECT j0, j1, y0, y1, n, CASE WHEN abs(a1) < 1e-13 THEN CASE n WHEN 0 THEN 1 / a0 ELSE 0 END ELSE CASE WHEN a1 > 0 AND n % 2 = 1 THEN -1 ELSE 1 END * pow(1 + d + sqrt(d * (d + 2)), -n) / (2 * abs(a1) * sqrt(d * (d + 2))) END AS t FROM ({gap}), range({reach + 3}) q(n)"
    line = f"lft AS ({left})"
    if kernel.name.endswith("L"):
        line += ", line AS (SELECT j0, j1, n, t FROM lft)"
    else:
        if kernel.order == 4:
            b = ("5 / 6.0::DOUBLE - (y0 + y1) / 3", "1 / 12.0::DOUBLE", "0")
        else:
            b = ("97 / 120.0::DOUBLE - 11 * (y0 + y1) / 45 + 8 * y0 * y1 / 45 - (y0 * y0 + y1 * y1) / 15", "0.1::DOUBLE - 2 * (y0 + y1) / 45", "-1 / 240.0::DOUBLE")
        moves = "(VALUES (0, 0), (1, 1), (-1, 1), (2, 2), (-2, 2)) s(step, kind)"
        weight = f"CASE kind WHEN 0 THEN {b[0]} WHEN 1 THEN {b[1]} ELSE {b[2]} END"
        line += f", line AS (SELECT j0, j1, m AS n, sum(t * {weight}) AS t FROM range({reach + 1}) p(m), {moves} JOIN lft ON lft.n = abs(m + step) GROUP BY j0, j1, m)"
    if axes == 3:
        one = f"one AS (SELECT j0, n, b, sum(t * wt * cos(b * k)) / pi() AS t FROM line JOIN node ON j = j1, range({reach + 1}) q(b) WHERE n <= {reach} GROUP BY j0, n, b)"
        near = f"near AS (SELECT n AS x, b AS y, a AS z, -sum(t * wt * cos(a * k)) / pi() / {H!r}::DOUBLE AS g FROM one JOIN node ON j = j0, range({reach + 1}) q(a) GROUP BY n, b, a)"
        return f"{nodes}, {line}, {one}, {near}"
    near = f"near AS (SELECT l.n AS x, b AS y, -sum(wt * (l.t * cos(b * k) - o.t)) / pi() AS g FROM line l JOIN line o ON o.j0 = l.j0 AND o.n = 0 JOIN node ON j = l.j0, range(9) q(b) WHERE l.n <= {reach} GROUP BY l.n, b)"
    return f"{nodes}, {line}, {near}"


def _near_sql(kernel: Kernel, axes: int, reach: int) -> str:
    return (_heat_sql if kernel.family == "LGF" else _compact_sql)(kernel, axes, reach)


# -- special functions ------------------------------------------------------------------------


def _special(spark, sf):
    """Values at a fifth of each quantity that is ordered."""

    def apply(batches):
        for b in batches:
            x = np.asarray(b.column("j")) / 5.0
            cols = [S.erf(x), S.si(x), S.e1(x), S.en(2, x), S.bessel_i(0, x), S.bessel_i(1, x), S.bessel_k(0, x), S.bessel_k(1, x), S.ji0c(x)]
            yield pa.RecordBatch.from_arrays([b.column("j"), *(pa.array(c) for c in cols)], names=["j", *_NAMES])

    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_quantity").cast("long").alias("j")).where("j > 0").distinct().mapInArrow(apply, "j long, " + ", ".join(f"{c} double" for c in _NAMES))
    return df.select("j", *(Q._round(c, 8).alias(c) for c in _NAMES))


_NAMES = ("erf", "si", "e1", "e2", "i0", "i1", "k0", "k1", "ji0c")
_SIMPSON = "CASE WHEN m = 0 OR m = 800 THEN 1 WHEN m % 2 = 1 THEN 4 ELSE 2 END"
_SPECIAL_SQL = f"""
WITH x AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS j, CAST(l_quantity AS BIGINT) / 5.0::DOUBLE AS x FROM lineitem WHERE l_quantity >= 1),
s AS (SELECT j, any_value(x) AS x, sum({_SIMPSON} * exp(-pow(x * m / 800, 2))) * any_value(x) / 2400 * 2 / sqrt(pi()) AS erf,
  sum({_SIMPSON} * CASE WHEN m = 0 THEN x ELSE sin(x * m / 800) / greatest(m / 800.0::DOUBLE, 1e-9) END) / 2400 AS si,
  sum({_SIMPSON} * CASE WHEN m = 0 THEN 0 ELSE (1 - list_sum(list_transform(range(64), lambda p: cos(x * m / 800 * sin(pi() * (p + 0.5::DOUBLE) / 64)))) / 64) / greatest(m / 800.0::DOUBLE, 1e-9) END) / 2400 AS ji0c
  FROM x, range(801) t(m) GROUP BY j),
h AS (SELECT k, sum(1.0::DOUBLE / k) OVER (ORDER BY k) AS harmonic FROM range(1, 120) t(k)),
e AS (SELECT j, exp(-any_value(x)) * sum(pow(x, k) / gamma(k + 1) * harmonic) - ln(any_value(x)) - {GAMMA} AS e1 FROM x, h GROUP BY j),
i AS (SELECT j, sum(pow(x / 2, 2 * k) / pow(gamma(k + 1), 2)) AS i0, sum(pow(x / 2, 2 * k + 1) / (gamma(k + 1) * gamma(k + 2))) AS i1 FROM x, range(60) t(k) GROUP BY j),
b AS (SELECT j, sum(CASE WHEN m = 0 THEN 0.5 ELSE 1 END * exp(-least(x * cosh(m / 20.0::DOUBLE), 700))) / 20 AS k0, sum(CASE WHEN m = 0 THEN 0.5 ELSE 1 END * exp(-least(x * cosh(m / 20.0::DOUBLE), 700)) * cosh(m / 20.0::DOUBLE)) / 20 AS k1 FROM x, range(240) t(m) GROUP BY j)
SELECT j, {", ".join(f"{Q._sql_round(e, 8)} AS {c}" for c, e in (("erf", "erf"), ("si", "si"), ("e1", "e1"), ("e2", "exp(-x) - x * e1"), ("i0", "i0"), ("i1", "i1"), ("k0", "k0"), ("k1", "k1"), ("ji0c", "ji0c")))}
FROM s JOIN e USING (j) JOIN i USING (j) JOIN b USING (j)
"""


# -- solves at node centres and with other images ---------------------------------------------


def _node_basis(left: int, right: int) -> str:
    """Rows (m, k, s, i, w, o): mode, wave number, inverse square norm, point, value, weight of the point in sums."""
    n = N
    if left == 3:
        rows = f"""SELECT m, 2 * pi() * m AS k, CASE WHEN m IN (0, {n // 2}) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END / {n} AS s, i, cos(2 * pi() * m * i / {n}) AS w FROM range({n // 2 + 1}) a(m), range({n + 1}) b(i)
UNION ALL SELECT {n} + m, 2 * pi() * m, 2.0::DOUBLE / {n}, i, sin(2 * pi() * m * i / {n}) FROM range(1, {n // 2}) a(m), range({n + 1}) b(i)"""
        return f"SELECT *, CASE WHEN i = {n} THEN 0.0::DOUBLE ELSE 1.0 END AS o FROM ({rows})"
    if left == right == 0:
        return f"SELECT m, pi() * m AS k, CASE WHEN m IN (0, {n}) THEN 1.0::DOUBLE ELSE 2.0 END / {n} AS s, i, cos(pi() * m * i / {n}) AS w, CASE WHEN i IN (0, {n}) THEN 0.5::DOUBLE ELSE 1.0 END AS o FROM range({n + 1}) a(m), range({n + 1}) b(i)"
    if left == right == 1:
        return f"SELECT m, pi() * m AS k, 2.0::DOUBLE / {n} AS s, i, sin(pi() * m * i / {n}) AS w, 1.0::DOUBLE AS o FROM range(1, {n}) a(m), range({n + 1}) b(i)"
    f, end = ("cos", 0) if left == 0 else ("sin", n)
    return f"SELECT m, pi() * (m + 0.5::DOUBLE) AS k, 2.0::DOUBLE / {n} AS s, i, {f}(pi() * (m + 0.5::DOUBLE) * i / {n}) AS w, CASE WHEN i = {end} THEN 0.5::DOUBLE ELSE 1.0 END AS o FROM range({n}) a(m), range({n + 1}) b(i)"


def _node_solve(code: str, kernel: Kernel, strategy: str):
    def run(spark, sf):
        s = FieldSolver(spark, GridSpec.of(code, N, Center.NODE), kernel, strategy=strategy, keep_green=False)
        return s.solve(Q._gridded(spark, sf)).select(*AXES, Q._round("v", 5).alias("v"))

    b = [_node_basis(int(code[2 * d]), int(code[2 * d + 1])) for d in range(3)]
    sql = f"""
WITH f AS ({Q._lineitem_sql()}), b0 AS ({b[0]}), b1 AS ({b[1]}), b2 AS ({b[2]}),
c0 AS (SELECT m AS m0, i1, i2, sum(v * w * o) AS v FROM f JOIN b0 ON i0 = i GROUP BY ALL),
c1 AS (SELECT m0, m AS m1, i2, sum(v * w * o) AS v FROM c0 JOIN b1 ON i1 = i GROUP BY ALL),
c2 AS (SELECT m0, m1, m AS m2, sum(v * w * o) AS v FROM c1 JOIN b2 ON i2 = i GROUP BY ALL),
k0 AS (SELECT DISTINCT m AS m0, k AS k0, s AS s0 FROM b0), k1 AS (SELECT DISTINCT m AS m1, k AS k1, s AS s1 FROM b1), k2 AS (SELECT DISTINCT m AS m2, k AS k2, s AS s2 FROM b2),
u AS (SELECT m0, m1, m2, CASE WHEN k0 = 0 AND k1 = 0 AND k2 = 0 THEN 0.0 ELSE v * s0 * s1 * s2 * ({_spectral(kernel)}) END AS v FROM c2 JOIN k0 USING (m0) JOIN k1 USING (m1) JOIN k2 USING (m2)),
d2 AS (SELECT m0, m1, i AS i2, sum(v * w) AS v FROM u JOIN b2 ON m2 = m GROUP BY ALL),
d1 AS (SELECT m0, i AS i1, i2, sum(v * w) AS v FROM d2 JOIN b1 ON m1 = m GROUP BY ALL),
d0 AS (SELECT i AS i0, i1, i2, sum(v * w) AS v FROM d1 JOIN b0 ON m0 = m GROUP BY ALL)
SELECT CAST(i0 AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1, CAST(i2 AS INTEGER) AS i2, {Q._sql_round('v', 5)} AS v FROM d0
"""
    return run, sql


def _images(code: str, center: Center, images: str, strategy: str = "pencil"):
    """Unbounded solves as direct sums over sources and their images (SQL rows i0, i1, i2, v from f)."""

    def run(spark, sf):
        s = FieldSolver(spark, GridSpec.of(code, N, center), Kernel.CHAT_2, strategy=strategy, keep_green=False)
        return s.solve(Q._gridded(spark, sf)).select(*AXES, Q._round("v", 5).alias("v"))

    n = N + (center == Center.NODE)
    sql = f"""
WITH f AS ({Q._lineitem_sql()}), s AS ({images}),
p AS (SELECT a, b, c FROM range({n}) x(a), range({n}) y(b), range({n}) z(c)),
d AS (SELECT a, b, c, v, {H!r} * sqrt(pow(a - i0, 2) + pow(b - i1, 2) + pow(c - i2, 2)) AS r FROM p, s)
SELECT {Q._INDEX}, {Q._sql_round(f"sum(v * {H ** 3!r} * CASE WHEN r = 0 THEN -0.5 * pow(3 * {H ** 3!r} / (4 * pi()), 2.0/3) / {H ** 3!r} ELSE -1 / (4 * pi() * CASE WHEN r = 0 THEN 1 ELSE r END) END)", 5)} AS v FROM d GROUP BY a, b, c
"""
    return run, sql


def _node_rotational():
    def run(spark, sf):
        s = FieldSolver(spark, GridSpec.of("333333", N, Center.NODE, components=3), Kernel.CHAT_2, Equation.ROT, Diff.SPE, strategy="pencil")
        return s.solve(Q._gridded(spark, sf, Q.MEASURES)).select("comp", *AXES, Q._round("v", 5).alias("v"))

    cell = Q._rotational(Diff.SPE, "pencil")[1]
    # the last point of each axis repeats the first
    sql = f"WITH u AS ({cell}) SELECT comp, {Q._INDEX}, v FROM u JOIN (SELECT * FROM range({N + 1}) x(a), range({N + 1}) y(b), range({N + 1}) z(c)) ON i0 = a % {N} AND i1 = b % {N} AND i2 = c % {N}"
    return run, sql


# -- small operators --------------------------------------------------------------------------


def _moved(spark, sf):
    """A sub-box of the gridded table, moved."""
    df = layout.box(Q._gridded(spark, sf), (1, 0, 2), (5, 7, 6))
    return layout.shift(df, (2, 0, -2)).select(*AXES, Q._round("v", 4).alias("v"))


_MOVED_SQL = f"WITH f AS ({Q._lineitem_sql()}) SELECT CAST(i0 + 2 AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1, CAST(i2 - 2 AS INTEGER) AS i2, {Q._sql_round('v', 4)} AS v FROM f WHERE i0 BETWEEN 1 AND 5 AND i2 BETWEEN 2 AND 6"


def _relative(spark, sf):
    f = Q._gridded(spark, sf)
    g = f.withColumn("v", F.col("v") * 1.25 + F.col("i0"))
    return analysis.relative_error(g, f).select(Q._round("rel_l2", 9).alias("rel_l2"))


_RELATIVE_SQL = f"WITH f AS ({Q._lineitem_sql()}) SELECT {Q._sql_round('sqrt(sum(pow(0.25 * v + i0, 2))) / sqrt(sum(v * v))', 9)} AS rel_l2 FROM f"


def _summary(spark, sf):
    s = analysis.summary(Q._gridded(spark, sf), GridSpec.of("333333", N))
    return s.select(*(Q._round(c, 6).alias(c) for c in ("v_min", "v_max", "v_mean", "integral")))


_SUMMARY_SQL = f"WITH f AS ({Q._lineitem_sql()}) SELECT {', '.join(f'{Q._sql_round(e, 6)} AS {c}' for c, e in (('v_min', 'min(v)'), ('v_max', 'max(v)'), ('v_mean', 'avg(v)'), ('integral', f'sum(v) * {H ** 3!r}::DOUBLE')))} FROM f"


# -- generated fields -------------------------------------------------------------------------

_CELLS = f"SELECT a, b, c, (a + 0.5::DOUBLE) / {N} AS x, (b + 0.5::DOUBLE) / {N} AS y, (c + 0.5::DOUBLE) / {N} AS z FROM range({N}) r0(a), range({N}) r1(b), range({N}) r2(c)"


def _product(code: str, which: str, value: str, waves: tuple[str, ...]):
    """A manufactured field of plain waves: its Laplacian is a multiple of it."""
    grid = GridSpec.of(code, (N, N, 1) if code.endswith("99") else N)

    def run(spark, sf):
        return Q.weighted(field_frame(spark, grid, which).drop("comp"), spark, sf)

    factor = "1.0::DOUBLE" if which == "solution" else "-(" + " + ".join(f"pow({k}, 2)" for k in waves) + ")"
    return run, Q.weighted_sql(f"SELECT a, b, c, {factor} * {value} AS v FROM ({_CELLS}) WHERE {'c = 0' if code.endswith('99') else 'true'}")


def _bump(x: str, second: bool) -> str:
    """The compact bump and its second derivative at distance ``x`` from its centre, half width 1/2."""
    q = f"pow(({x}) / 0.5, 2)"
    f = f"exp(10 * (1 - 1 / (1 - least({q}, 0.999999::DOUBLE))))"
    f = f"{f} * 20 * (18 * {q} + 3 * {q} * {q} - 1) / pow({q} - 1, 4) / 0.25" if second else f
    return f"CASE WHEN {q} < 1 THEN {f} ELSE 0 END"


def _bump_images(which: str):
    """A bump and its mirror image behind a wall, times a bump in free space, times a wave."""
    grid = GridSpec.of("044433", N)

    def run(spark, sf):
        return Q.weighted(field_frame(spark, grid, which).drop("comp"), spark, sf)

    f = [f"({_bump('x - 0.3', s)} + {_bump('x + 0.3', s)})" for s in (False, True)]
    g = [f"({_bump('y - 0.5', s)})" for s in (False, True)]
    wave, k2 = "sin(8 * pi() * z)", "64 * pi() * pi()"
    value = f"{f[0]} * {g[0]} * {wave}"
    total = value if which == "solution" else f"({f[1]} * {g[0]} + {f[0]} * {g[1]} - {k2} * {f[0]} * {g[0]}) * {wave}"
    return run, Q.weighted_sql(f"SELECT a, b, c, {total} AS v FROM ({_CELLS})")


def _compact_vortex(which: str):
    def run(spark, sf):
        return Q.weighted(vortex_tube(spark, GridSpec.of("444433", N, components=3), 2, radius=0.4, which=which), spark, sf)

    q = "least(r2 / 0.16::DOUBLE, 1)"
    w = f"4 / (pi() * 0.16) * pow(1 - {q}, 3)"
    u = f"(1 - pow(1 - {q}, 4)) / (2 * pi() * r2)"  # no cell centre lies on the axis
    v = f"CASE WHEN comp = 2 THEN -{w} ELSE 0 END" if which == "rhs" else f"CASE comp WHEN 0 THEN -(y - 0.5) * {u} WHEN 1 THEN (x - 0.5) * {u} ELSE 0 END"
    return run, Q.weighted_sql(f"SELECT comp, a, b, c, {v} AS v FROM (SELECT *, pow(x - 0.5, 2) + pow(y - 0.5, 2) AS r2 FROM ({_CELLS}), range(3) t(comp))")


def _vectors(make, which: str, values: tuple[str, str, str], code: str = "333333"):
    def run(spark, sf):
        return Q.weighted(make(spark, GridSpec.of(code, N, components=3), which), spark, sf)

    body = " ".join(f"WHEN {c} THEN {v}" for c, v in enumerate(values))
    return run, Q.weighted_sql(f"SELECT comp, a, b, c, CASE comp {body} END AS v FROM ({_CELLS}), range(3) t(comp)")


def _blob(which: str):
    def run(spark, sf):
        return Q.weighted(gaussian_blob(spark, GridSpec.of("444444", N), 0.1, which).drop("comp"), spark, sf)

    # the potential of a Gaussian as an integral over widths: Simpson's rule for erf(r / (sqrt(2) sigma)) / r
    weight = "CASE WHEN m = 0 OR m = 400 THEN 1 WHEN m % 2 = 1 THEN 4 ELSE 2 END"
    erf = f"sum({weight} * exp(-r2 * pow(m / 400.0::DOUBLE, 2) / 0.02)) / 1200 * 2 / sqrt(pi()) / (sqrt(2) * 0.1)"
    r2 = f"SELECT a, b, c, pow(x - 0.5, 2) + pow(y - 0.5, 2) + pow(z - 0.5, 2) AS r2 FROM ({_CELLS})"
    if which == "rhs":
        return run, Q.weighted_sql(f"SELECT a, b, c, exp(r2 / -0.02) / pow(2 * pi() * 0.01, 1.5) AS v FROM ({r2})")
    return run, Q.weighted_sql(f"SELECT a, b, c, -{erf} / (4 * pi()) AS v FROM ({r2}), range(401) t(m) GROUP BY a, b, c")


def _gaussian(which: str):
    def run(spark, sf):
        return Q.weighted(gaussian_line(spark, GridSpec.of("334433", N), 1, 0.1, which).drop("comp"), spark, sf)

    f = "exp(-pow((y - 0.5) / 0.1, 2) / 2)" + (" * (pow((y - 0.5) / 0.1, 2) - 1) / 0.01" if which == "rhs" else "")
    return run, Q.weighted_sql(f"SELECT a, b, c, {f} AS v FROM ({_CELLS})")


def _kappa(diff: Diff, k: str) -> str:
    """Factor of a first derivative at wave number ``k``."""
    weights = {Diff.SPE: None, Diff.FD2: (1.0,), Diff.FD4: (4 / 3, -1 / 6), Diff.FD6: (3 / 2, -3 / 10, 1 / 30)}[diff]
    return k if weights is None else "(" + " + ".join(f"({w!r}::DOUBLE) * sin({k} * {m * H!r}::DOUBLE) / {H!r}::DOUBLE" for m, w in enumerate(weights, 1)) + ")"


def _slope_sql(left: int, diff: Diff) -> str:
    """The derivatives of ``Q._basis_sql``'s functions: rows (m, i, w)."""
    x = f"(i + 0.5::DOUBLE) / {N}"
    if left == 3:
        k = "2 * pi() * m"
        return f"""SELECT m, i, -sin(2 * pi() * m * i / {N}) * {_kappa(diff, k)} AS w FROM range({N // 2 + 1}) a(m), range({N}) b(i)
UNION ALL SELECT {N} + m, i, cos(2 * pi() * m * i / {N}) * {_kappa(diff, k)} FROM range(1, {N // 2}) a(m), range({N}) b(i)"""
    k = "pi() * m"
    if left == 0:
        return f"SELECT m, i, -sin(pi() * m * {x}) * {_kappa(diff, k)} AS w FROM range({N}) a(m), range({N}) b(i)"
    return f"SELECT m, i, cos(pi() * m * {x}) * {_kappa(diff, k)} AS w FROM range(1, {N + 1}) a(m), range({N}) b(i)"


WALLS = (((0, 0), (1, 1), (3, 3)), ((1, 1), (0, 0), (3, 3)), ((1, 1), (1, 1), (3, 3)))


def _wall_curl(diff: Diff, strategy: str):
    """Three measures of the table between walls that are odd for some components and even for others: the curl of each
    component's expansion, over its wave numbers squared."""
    grid = GridSpec((N, N, N), WALLS, components=3)

    def run(spark, sf):
        s = FieldSolver(spark, grid, Kernel.CHAT_2, Equation.ROT, diff, strategy=strategy, keep_green=False)
        return s.solve(Q._gridded(spark, sf, Q.MEASURES)).select("comp", *AXES, Q._round("v", 5).alias("v"))

    bases = {f"w{left}": Q._basis_sql(left, left, N) for left in (0, 1, 3)} | {f"d{left}": _slope_sql(left, diff) for left in (0, 1, 3)}
    parts = [f"{name} AS ({sql})" for name, sql in bases.items()]
    for c in range(3):
        b = [f"w{WALLS[c][d][0]}" for d in range(3)]
        parts.append(f"e{c} AS (SELECT m AS m0, k AS k0, s AS s0, i1, i2, sum(v * w) AS v FROM f JOIN {b[0]} ON i0 = i WHERE comp = {c} GROUP BY ALL)")
        parts.append(f"g{c} AS (SELECT m0, k0, s0, m AS m1, k AS k1, s AS s1, i2, sum(v * w) AS v FROM e{c} JOIN {b[1]} ON i1 = i GROUP BY ALL)")
        parts.append(f"h{c} AS (SELECT m0, k0, s0, m1, k1, s1, m AS m2, k AS k2, s AS s2, sum(v * w) AS v FROM g{c} JOIN {b[2]} ON i2 = i GROUP BY ALL)")
        parts.append(f"u{c} AS (SELECT m0, m1, m2, -v * s0 * s1 * s2 / (k0 * k0 + k1 * k1 + k2 * k2) AS v FROM h{c} WHERE k0 + k1 + k2 > 0)")
    terms = []
    for to, pairs in enumerate((((1, 2, 1), (2, 1, -1)), ((2, 0, 1), (0, 2, -1)), ((0, 1, 1), (1, 0, -1)))):
        for axis, c, sign in pairs:
            b = [f"{'d' if d == axis else 'w'}{WALLS[c][d][0]}" for d in range(3)]
            terms.append(
                f"SELECT {to} AS comp, x.i AS i0, y.i AS i1, z.i AS i2, {sign} * u.v * x.w * y.w * z.w AS v FROM u{c} u JOIN {b[0]} x ON x.m = u.m0 JOIN {b[1]} y ON y.m = u.m1 JOIN {b[2]} z ON z.m = u.m2"
            )
    sql = f"WITH f AS ({Q._lineitem_sql(Q.MEASURES)}), {', '.join(parts)} SELECT CAST(comp AS INTEGER) AS comp, CAST(i0 AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1, CAST(i2 AS INTEGER) AS i2, {Q._sql_round('sum(v)', 5)} AS v FROM ({' UNION ALL '.join(terms)}) GROUP BY ALL"
    return run, sql


def _stored_table(spark, sf):
    """A solve whose Green's table is stored on the shared folder first and read from there."""
    library = GreenLibrary(spark, Q._shared(spark, "green"))
    library.octant(GridSpec.of("444433", N), Kernel.HEJ_4, slabs=True)
    s = FieldSolver(spark, GridSpec.of("444433", N), Kernel.HEJ_4, strategy="slab", library=library)
    return s.solve(Q._gridded(spark, sf)).select(*AXES, Q._round("v", 3).alias("v"))


def _shear_solve():
    """The measures of the table on top of generated shear waves: one solve of both."""
    two = "2 * pi()"

    def run(spark, sf):
        grid = GridSpec.of("333333", N, components=3)
        data = Q._gridded(spark, sf, Q.MEASURES).unionByName(shear_waves(spark, grid)).groupBy("rhs_id", "comp", *AXES).agg(F.sum("v").alias("v"))
        s = FieldSolver(spark, grid, Kernel.CHAT_2, Equation.ROT, Diff.SPE, strategy="slab")
        return s.solve(data).select("comp", *AXES, Q._round("v", 3).alias("v"))

    waves = " ".join(f"WHEN {c} THEN cos({two} * {x}) / ({two})" for c, x in enumerate("zxy"))
    return run, f"WITH u AS ({Q._rotational(Diff.SPE, 'slab', 9)[1]}), g AS (SELECT t.comp AS comp, a, b, c, CASE t.comp {waves} END AS v FROM ({_CELLS}), range(3) t(comp)) SELECT u.comp AS comp, u.i0, u.i1, u.i2, {Q._sql_round('u.v + g.v', 3)} AS v FROM u JOIN g ON g.comp = u.comp AND a = i0 AND b = i1 AND c = i2"


def _orders(spark, sf):
    """Orders between resolutions of a norm of the gridded table: cells that halve hold an eighth of the table each."""
    rows, items = None, spark.read.parquet(f"{sf}/lineitem.parquet")
    for n in (2, 4, 8, 16):
        one = lineitem_grid(items, n, Q.MEASURES).groupBy("comp").agg(F.max("v").alias("err")).select(F.concat(F.lit("m"), "comp").alias("kernel"), F.lit(n).alias("n"), "err")
        rows = one if rows is None else rows.unionByName(one)
    return analysis.convergence(rows).select("kernel", "n", Q._round("err", 4).alias("err"), Q._round("order", 6).alias("order"))


def _orders_sql() -> str:
    one = " UNION ALL ".join(
        f"SELECT 'm{c}' AS kernel, {n} AS n, max(v) AS err FROM (SELECT sum(CAST({m} AS DOUBLE)) AS v FROM lineitem GROUP BY l_partkey % {n}, l_suppkey % {n}, l_orderkey % {n})" for n in (2, 4, 8, 16) for c, m in enumerate(Q.MEASURES)
    )
    order = "ln(lag(err) OVER w / err) / ln(n / lag(n) OVER w)"
    return f"SELECT kernel, n, {Q._sql_round('err', 4)} AS err, {Q._sql_round(order, 6)} AS \"order\" FROM ({one}) WINDOW w AS (PARTITION BY kernel ORDER BY n)"


def build() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for kernel in (*HEJ, Kernel.HEJ_0, *LATTICE):
        name = kernel.name.lower()
        out[f"green_table_free_{name}"] = (_solved("444444", kernel, "slab" if kernel in LATTICE else "rows"), _free_sql(kernel))
        out[f"green_table_mixed_{name}"] = (_solved("444433", kernel, "pencil"), _mixed_sql(kernel))
        out[f"green_table_plane_{name}"] = (_solved("044499", kernel, "rows"), _plane_sql(kernel))
    for kernel in (*HEJ, Kernel.HEJ_0):
        name = kernel.name.lower()
        out[f"green_free_{name}"] = (_solved("444444", kernel, "pencil"), _free_sql(kernel))
        if kernel != Kernel.HEJ_0:
            out[f"green_line_{name}"] = (_solved("443300", kernel, "pencil"), _line_sql(kernel))
    for kernel in (Kernel.CHAT_2, Kernel.LGF_2, Kernel.MEHR_4L):
        out[f"green_line_{kernel.name.lower()}"] = (_solved("443300", kernel, "pencil"), _line_sql(kernel))
    out["green_free_chat_2"] = Q._free("slab")
    out["green_plane_chat_2"] = (_solved("044499", Kernel.CHAT_2, "pencil"), _log_sql())
    out["green_mixed_chat_2"] = (_solved("444433", Kernel.CHAT_2, "pencil"), _bessel_sql())
    for kernel in LATTICE:
        name = kernel.name.lower()
        out[f"lattice_free_{name}"] = _residual("444444", kernel)
        out[f"lattice_plane_{name}"] = _residual("444499", kernel)
        out[f"lattice_line_{name}"] = _residual("443300", kernel)
        out[f"lattice_far_{name}"] = _far_field(kernel)
    out["solve_with_stored_table"] = (_stored_table, _mixed_sql(Kernel.HEJ_4))
    out["special_functions"] = (_special, _SPECIAL_SQL)
    for name, code, kernel, strategy in (("walls", "001101", Kernel.CHAT_2, "pencil"), ("mixed_walls", "330010", Kernel.LGF_4, "slab"), ("periodic", "333333", Kernel.CHAT_2, "slab"), ("compact", "113333", Kernel.MEHR_6F, "pencil")):
        out[f"solve_{name}_node"] = _node_solve(code, kernel, strategy)
    whole = "SELECT i0, i1, i2, v FROM f"
    out["solve_free_node"] = _images("444444", Center.NODE, whole)
    out["solve_half_free_node"] = _images("144444", Center.NODE, f"{whole} UNION ALL SELECT -i0, i1, i2, -v FROM f")
    out["solve_half_free_even"] = _images("044444", Center.CELL, f"{whole} UNION ALL SELECT -1 - i0, i1, i2, v FROM f", "slab")
    out["solve_half_free_even_node"] = _images("044444", Center.NODE, f"{whole} UNION ALL SELECT -i0, i1, i2, v FROM f WHERE i0 > 0")
    out["solve_half_free_right"] = _images("404444", Center.CELL, f"{whole} UNION ALL SELECT {2 * N - 1} - i0, i1, i2, v FROM f")
    out["solve_half_free_odd_right"] = _images("414444", Center.CELL, f"{whole} UNION ALL SELECT {2 * N - 1} - i0, i1, i2, -v FROM f")
    out["solve_rotational_node"] = _node_rotational()
    out["field_moved"] = (_moved, _MOVED_SQL)
    out["field_relative_error"] = (_relative, _RELATIVE_SQL)
    out["field_summary"] = (_summary, _SUMMARY_SQL)
    for which in ("rhs", "solution"):
        out[f"field_walls_{which}"] = _product("000111", which, "cos(pi() * x) * cos(2.5 * pi() * y) * sin(8 * pi() * z)", ("pi()", "2.5 * pi()", "8 * pi()"))
        out[f"field_plane_{which}"] = _product("100099", which, "sin(1.5 * pi() * x) * cos(2 * pi() * y)", ("1.5 * pi()", "2 * pi()"))
        out[f"field_bump_image_{which}"] = _bump_images(which)
        out[f"vortex_compact_{which}"] = _compact_vortex(which)
        out[f"field_blob_{which}"] = _blob(which)
        out[f"field_gaussian_{which}"] = _gaussian(which)
    two = "2 * pi()"
    out["shear_rhs"] = _vectors(shear_waves, "rhs", (f"sin({two} * y)", f"sin({two} * z)", f"sin({two} * x)"))
    out["shear_solution"] = _vectors(shear_waves, "solution", (f"cos({two} * z) / ({two})", f"cos({two} * x) / ({two})", f"cos({two} * y) / ({two})"))
    out["wall_waves_rhs"] = _vectors(wall_waves, "rhs", ("0", "0", "sin(pi() * x) * sin(2 * pi() * y)"))
    out["wall_waves_solution"] = _vectors(wall_waves, "solution", ("-sin(pi() * x) * cos(2 * pi() * y) * 2 / (5 * pi())", "cos(pi() * x) * sin(2 * pi() * y) / (5 * pi())", "0"))
    out["solve_shear_waves"] = _shear_solve()
    for diff, strategy in ((Diff.SPE, "pencil"), (Diff.FD2, "slab"), (Diff.FD4, "pencil"), (Diff.FD6, "slab")):
        out[f"solve_wall_waves_{diff.name.lower()}"] = _wall_curl(diff, strategy)
    out["orders_of_errors"] = (_orders, _orders_sql())
    return out
