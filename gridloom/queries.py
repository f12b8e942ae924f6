"""Queries of the field engine on the driver's tables, each with DuckDB SQL that computes the same
numbers another way: transforms as sums over basis functions, spectral solves as eigenfunction
expansions, unbounded solves as direct sums over all sources."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import analysis, blocks, layout, longline, pencil, transform
from gridloom.operators.layout import AXES
from gridloom.plans.spec import Center, Diff, Equation, GridSpec, Kernel
from gridloom.solver import FieldSolver
from gridloom.sources.generate import field_frame, vortex_tube
from gridloom.sources import files, raw
from gridloom.sources.gridded import by_minute, hourly, lineitem_grid

LINE = 64  # length of an embedding
N = 8  # cells along each axis of gridded fields


def _round(c, digits: int = 6):
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _sql_round(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0"


# -- transforms of embeddings -----------------------------------------------------------------

#: basis function of each real transform: weight of point j (0-based) in mode k, n points
BASIS = {
    "dct1": "CASE WHEN j = 0 THEN 1.0 WHEN j = {n} - 1 THEN CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END ELSE 2 * cos(pi() * j * k / ({n} - 1)) END",
    "dct2": "2 * cos(pi() * (j + 0.5) * k / {n})",
    "dct3": "CASE WHEN j = 0 THEN 1.0 ELSE 2 * cos(pi() * j * (k + 0.5) / {n}) END",
    "dct4": "2 * cos(pi() * (j + 0.5) * (k + 0.5) / {n})",
    "dst1": "2 * sin(pi() * (j + 1) * (k + 1) / ({n} + 1))",
    "dst2": "2 * sin(pi() * (j + 0.5) * (k + 1) / {n})",
    "dst3": "CASE WHEN j = {n} - 1 THEN CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END ELSE 2 * sin(pi() * (j + 1) * (k + 0.5) / {n}) END",
    "dst4": "2 * sin(pi() * (j + 0.5) * (k + 0.5) / {n})",
}
INVERSE = {"dct1": ("dct1", 2 * (LINE - 1)), "dct2": ("dct3", 2 * LINE), "dct3": ("dct2", 2 * LINE), "dct4": ("dct4", 2 * LINE),
           "dst1": ("dst1", 2 * (LINE + 1)), "dst2": ("dst3", 2 * LINE), "dst3": ("dst2", 2 * LINE), "dst4": ("dst4", 2 * LINE)}

_POINTS = f"WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range({LINE})) AS j FROM embeddings)"


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


def _unfold(df: DataFrame, column: str, value: str, at: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias(at, "_v")).select("vec_id", F.col(at).cast("long").alias(at), _round("_v").alias(value))


def _real(name):
    def run(spark, sf):
        return _unfold(pencil.transform(_embeddings(spark, sf), "vec_id", "embedding", name), "y", "y", "k")

    basis = BASIS[name].format(n=LINE)
    sql = f"{_POINTS}, b AS (SELECT k, j, {basis} AS w FROM range({LINE}) a(k), range({LINE}) c(j)) SELECT vec_id, k, {_sql_round('sum(x * w)')} AS y FROM e JOIN b USING (j) GROUP BY vec_id, k"
    return run, sql


def _round_trip(name):
    inverse, norm = INVERSE[name]

    def run(spark, sf):
        y = pencil.transform(_embeddings(spark, sf), "vec_id", "embedding", name)
        x = pencil.transform(y, "vec_id", "y", inverse, "x").withColumn("x", F.transform("x", lambda v: v / norm))
        return _unfold(x, "x", "x", "j")

    return run, f"{_POINTS} SELECT vec_id, j, {_sql_round('x')} AS x FROM e"


def _dft(spark, sf):
    y = pencil.dft(_embeddings(spark, sf), "vec_id", "embedding")
    y = y.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return y.select("vec_id", F.col("k").cast("long").alias("k"), _round("z.re").alias("re"), _round("z.im").alias("im"))


_DFT_SQL = f"{_POINTS}, b AS (SELECT k, j, 2 * pi() * k * j / {LINE} AS t FROM range({LINE // 2 + 1}) a(k), range({LINE}) c(j)) SELECT vec_id, k, {_sql_round('sum(x * cos(t))')} AS re, {_sql_round('-sum(x * sin(t))')} AS im FROM e JOIN b USING (j) GROUP BY vec_id, k"


def _dft_round_trip(spark, sf):
    y = pencil.idft(pencil.dft(_embeddings(spark, sf), "vec_id", "embedding"), "vec_id", LINE)
    return _unfold(y.withColumn("x", F.transform("y", lambda v: v / LINE)), "x", "x", "j")


def _basis_columns(spark, sf):
    """DCT-II as pure column arithmetic."""
    y = pencil.basis_transform(F.col("embedding"), LINE, lambda k, j: 2 * F.cos(math.pi * (j + 0.5) * k / LINE))
    return _unfold(_embeddings(spark, sf).select("vec_id", y.alias("y")), "y", "y", "k")


# -- plans and indices ------------------------------------------------------------------------


def _plans(spark, sf):
    """The profile of the gridded table along its first axis, laid into the lines of every pair of sides: where its points go,
    and the mode of the same number."""
    rows = []
    for center in Center:
        for left, right in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 4), (4, 0), (1, 4), (4, 1), (3, 3), (4, 4)):
            p = GridSpec.of(f"{left}{right}0000", N, center).plan(0)
            rows.append((int(center), left, right, p.n, p.modes(p.complex), p.kfact, p.koffset, p.normfact, p.volfact, p.offset))
    names = ("center", "bc_left", "bc_right", "points", "modes", "kfact", "koffset", "normfact", "volfact", "pad")
    plans = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(names, r))) for r in rows))
    profile = _gridded(spark, sf).groupBy("i0").agg(F.sum("v").alias("v"))
    laid = profile.select("i0", "v", F.explode(plans).alias("p")).select("i0", "v", "p.*")
    return laid.select(
        "center", "bc_left", "bc_right", "points", "modes", "i0", (F.col("i0") + F.col("pad")).alias("at"), _round(F.col("v") * F.col("normfact") * F.col("volfact"), 4).alias("v"),
        _round((F.col("i0") + F.col("koffset")) * F.col("kfact"), 9).alias("k"),
    )


def _plans_sql() -> str:
    return f"""
WITH f AS ({_lineitem_sql()}), g AS (SELECT i0, sum(v) AS v FROM f GROUP BY i0),
s AS (SELECT unnest([0, 0, 1, 1, 0, 4, 1, 4, 3, 4]) AS bc_left, unnest([0, 1, 0, 1, 4, 0, 4, 1, 3, 4]) AS bc_right),
p AS (SELECT center, bc_left, bc_right, CAST({N} + 1 - center AS INTEGER) AS points, bc_left + bc_right AS t, (bc_left < 2 AND bc_right < 2) AS sym, (bc_left = 4) <> (bc_right = 4) AS mixed
  FROM s, (SELECT unnest([0, 1]) AS center)),
q AS (SELECT *, CAST(CASE WHEN sym THEN CASE WHEN center = 1 AND bc_left = bc_right THEN {N} + 1 ELSE points END WHEN mixed THEN 2 * {N} + 1 WHEN t = 6 THEN {N // 2} + 1 ELSE {N} + 1 END AS INTEGER) AS modes,
  pi() * CASE WHEN sym THEN 1 WHEN mixed THEN 0.5 WHEN t = 6 THEN 2 ELSE 1 END AS kfact, CASE WHEN sym AND bc_left <> bc_right THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS koffset,
  1.0::DOUBLE / CASE WHEN sym THEN {2 * N} WHEN mixed THEN {4 * N} WHEN t = 6 THEN {N} ELSE {2 * N} END AS normfact, CASE WHEN bc_left = 4 OR bc_right = 4 THEN 0.125::DOUBLE ELSE 1.0::DOUBLE END AS volfact,
  CASE WHEN mixed AND bc_left = 4 THEN {N} ELSE 0 END AS pad FROM p)
SELECT center, bc_left, bc_right, points, modes, CAST(i0 AS INTEGER) AS i0, CAST(i0 + pad AS INTEGER) AS "at", {_sql_round('v * normfact * volfact', 4)} AS v, {_sql_round('(i0 + koffset) * kfact', 9)} AS k FROM q, g
"""


def _mirrored(spark, sf):
    """Every mode of an embedding's transform, read from its half spectrum at the mirrored index."""
    y = pencil.dft(_embeddings(spark, sf), "vec_id", "embedding")
    k = F.explode(F.sequence(F.lit(0), F.lit(LINE - 1)))
    y = y.select("vec_id", "re", "im", k.alias("k"))
    y = y.select("vec_id", "k", "re", "im", layout.sym_id(F.col("k"), LINE // 2).cast("int").alias("s"), layout.sym_id(F.col("k"), LINE // 2, False).cast("int").alias("p"))
    im = F.get("im", F.col("p")) * F.when(F.col("s") < 0, -1.0).otherwise(1.0)
    return y.select("vec_id", F.col("k").cast("long").alias("k"), F.col("s").alias("signed_id"), _round(F.get("re", F.col("p"))).alias("re"), _round(im).alias("im"))


_MIRRORED_SQL = f"{_POINTS}, b AS (SELECT k, j, 2 * pi() * k * j / {LINE} AS t FROM range({LINE}) a(k), range({LINE}) c(j)) SELECT vec_id, k, CAST(CASE WHEN k <= {LINE // 2} THEN k ELSE k - {LINE} END AS INTEGER) AS signed_id, {_sql_round('sum(x * cos(t))')} AS re, {_sql_round('-sum(x * sin(t))')} AS im FROM e JOIN b USING (j) GROUP BY vec_id, k"


def _linear_index(spark, sf):
    """Linear indices of the points of the gridded table."""
    df = _gridded(spark, sf)
    return df.select(*AXES, layout.collapsed((N, N, N), *(F.col(a) for a in AXES)).cast("int").alias("id"), _round("v", 4).alias("v"))


def _linear_sql() -> str:
    return f"WITH f AS ({_lineitem_sql()}) SELECT CAST(i0 AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1, CAST(i2 AS INTEGER) AS i2, CAST(i0 + {N} * i1 + {N * N} * i2 AS INTEGER) AS id, {_sql_round('v', 4)} AS v FROM f"


# -- Green's functions ------------------------------------------------------------------------


def _green_sql(kernel: Kernel, h: float) -> str:
    """The fully spectral form over columns k0, k1, k2, written out."""
    k2 = "(k0*k0 + k1*k1 + k2*k2)"
    if kernel in (Kernel.CHAT_2, Kernel.HEJ_0):
        return f"-1.0 / {k2}"
    if kernel.family == "HEJ":
        q = f"({k2} * {(2 * h) ** 2!r}::DOUBLE)"
        p = " + ".join(f"pow({q}, {i}) / {f}" for i, f in list(enumerate((1, 2, 8, 48, 384)))[: kernel.order // 2])
        return f"-({p}) * exp(-{q} / 2) / {k2}"
    y = [f"pow(sin(k{d} * {h / 2!r}), 2)" for d in range(3)]
    if kernel.family == "LGF":
        weights = {2: (1.0,), 4: (4 / 3, -1 / 12), 6: (3 / 2, -3 / 20, 1 / 90), 8: (8 / 5, -1 / 5, 8 / 315, -1 / 560)}[kernel.order]
        total = " + ".join(f"4 * ({w!r}::DOUBLE) * pow(sin(k{d} * {m * h / 2!r}), 2)" for d in range(3) for m, w in enumerate(weights, 1))
        return f"-{h * h!r}::DOUBLE / ({total})"
    pairs = f"({y[0]}*{y[1]} + {y[1]}*{y[2]} + {y[0]}*{y[2]})"
    sums = f"({y[0]} + {y[1]} + {y[2]})"
    ell = f"(-4 * {sums} + 8 * {pairs} / 3" + (f" - 32 * {y[0]}*{y[1]}*{y[2]} / 15)" if kernel.order == 6 else ")")
    top = {"MEHR_4F": f"(1 - {sums} / 3)", "MEHR_6F": f"(1 - {sums} / 3 + 8 * {pairs} / 45 - (pow({y[0]}, 2) + pow({y[1]}, 2) + pow({y[2]}, 2)) / 15)"}.get(kernel.name, "1.0")
    return f"{h * h!r}::DOUBLE * {top} / {ell}"


_INDEX = "CAST(a AS INTEGER) AS i0, CAST(b AS INTEGER) AS i1, CAST(c AS INTEGER) AS i2"
_H = 1 / N


# -- solves of gridded tables -----------------------------------------------------------------


def _basis_sql(left: int, right: int, n: int) -> str:
    """Rows (m, k, s, i, w): orthogonal basis of an axis: mode, wave number, inverse square norm, point, value."""
    if left == 3:
        return f"""SELECT * FROM (SELECT m, 2 * pi() * m AS k, CASE WHEN m IN (0, {n // 2}) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END / {n} AS s, i, cos(2 * pi() * m * i / {n}) AS w FROM range({n // 2 + 1}) a(m), range({n}) b(i)
UNION ALL SELECT {n} + m, 2 * pi() * m, 2.0::DOUBLE / {n}, i, sin(2 * pi() * m * i / {n}) FROM range(1, {n // 2}) a(m), range({n}) b(i))"""
    x = f"(i + 0.5::DOUBLE) / {n}"
    if left == right == 0:
        return f"SELECT m, pi() * m AS k, CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END / {n} AS s, i, cos(pi() * m * {x}) AS w FROM range({n}) a(m), range({n}) b(i)"
    if left == right == 1:
        return f"SELECT m, pi() * m AS k, CASE WHEN m = {n} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END / {n} AS s, i, sin(pi() * m * {x}) AS w FROM range(1, {n} + 1) a(m), range({n}) b(i)"
    f = "cos" if left == 0 else "sin"
    return f"SELECT m, pi() * (m + 0.5::DOUBLE) AS k, 2.0::DOUBLE / {n} AS s, i, {f}(pi() * (m + 0.5::DOUBLE) * {x}) AS w FROM range({n}) a(m), range({n}) b(i)"


def _lineitem_sql(measures=("l_quantity",)) -> str:
    return " UNION ALL ".join(
        f"SELECT {c} AS comp, l_partkey % {N} AS i0, l_suppkey % {N} AS i1, l_orderkey % {N} AS i2, sum(CAST({m} AS DOUBLE)) AS v FROM lineitem GROUP BY ALL" for c, m in enumerate(measures)
    )


def _expansion_sql(code: str, kernel: Kernel, factor: str = "1.0", source: str | None = None, key: str = "") -> str:
    """``source`` gives i0, i1, i2, v and perhaps a ``key`` column of several fields."""
    b = [_basis_sql(int(code[2 * d]), int(code[2 * d + 1]), N) for d in range(3)]
    k = f"{key}, " if key else ""
    return f"""
WITH f AS ({source or _lineitem_sql()}), b0 AS ({b[0]}), b1 AS ({b[1]}), b2 AS ({b[2]}),
c0 AS (SELECT {k}m AS m0, i1, i2, sum(v * w) AS v FROM f JOIN b0 ON i0 = i GROUP BY ALL),
c1 AS (SELECT {k}m0, m AS m1, i2, sum(v * w) AS v FROM c0 JOIN b1 ON i1 = i GROUP BY ALL),
c2 AS (SELECT {k}m0, m1, m AS m2, sum(v * w) AS v FROM c1 JOIN b2 ON i2 = i GROUP BY ALL),
k0 AS (SELECT DISTINCT m AS m0, k AS k0, s AS s0 FROM b0), k1 AS (SELECT DISTINCT m AS m1, k AS k1, s AS s1 FROM b1), k2 AS (SELECT DISTINCT m AS m2, k AS k2, s AS s2 FROM b2),
u AS (SELECT {k}m0, m1, m2, CASE WHEN k0 = 0 AND k1 = 0 AND k2 = 0 THEN 0.0 ELSE v * s0 * s1 * s2 * ({factor}) * ({_green_sql(kernel, 1 / N)}) END AS v FROM c2 JOIN k0 USING (m0) JOIN k1 USING (m1) JOIN k2 USING (m2)),
d2 AS (SELECT {k}m0, m1, i AS i2, sum(v * w) AS v FROM u JOIN b2 ON m2 = m GROUP BY ALL),
d1 AS (SELECT {k}m0, i AS i1, i2, sum(v * w) AS v FROM d2 JOIN b1 ON m1 = m GROUP BY ALL),
d0 AS (SELECT {k}i AS i0, i1, i2, sum(v * w) AS v FROM d1 JOIN b0 ON m0 = m GROUP BY ALL)
SELECT {k}CAST(i0 AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1, CAST(i2 AS INTEGER) AS i2, {_sql_round('v', 5)} AS v FROM d0
"""


def _gridded(spark, sf, measures=("l_quantity",)):
    return lineitem_grid(spark.read.parquet(f"{sf}/lineitem.parquet"), N, measures)


def _solve(code: str, kernel: Kernel, strategy: str, spectral=None, factor: str = "1.0"):
    def run(spark, sf):
        s = FieldSolver(spark, GridSpec.of(code, N), kernel, strategy=strategy, keep_green=False)
        return s.solve(_gridded(spark, sf), spectral).select(*AXES, _round("v", 5).alias("v"))

    return run, _expansion_sql(code, kernel, factor)


def _free(strategy: str):
    def run(spark, sf):
        s = FieldSolver(spark, GridSpec.of("444444", N), Kernel.CHAT_2, strategy=strategy, keep_green=False)
        return s.solve(_gridded(spark, sf)).select(*AXES, _round("v", 5).alias("v"))

    sql = f"""
WITH f AS ({_lineitem_sql()}), p AS (SELECT a, b, c FROM range({N}) x(a), range({N}) y(b), range({N}) z(c)),
d AS (SELECT a, b, c, v, {_H!r} * sqrt(pow(a - i0, 2) + pow(b - i1, 2) + pow(c - i2, 2)) AS r FROM p, f)
SELECT {_INDEX}, {_sql_round(f"sum(v * {_H ** 3!r} * CASE WHEN r = 0 THEN -0.5 * pow(3 * {_H ** 3!r} / (4 * pi()), 2.0/3) / {_H ** 3!r} ELSE -1 / (4 * pi() * CASE WHEN r = 0 THEN 1 ELSE r END) END)", 5)} AS v FROM d GROUP BY a, b, c
"""
    return run, sql


def _half_free():
    """Unbounded on the right of the first axis, a wall of odd symmetry on its left: an image of the opposite sign."""

    def run(spark, sf):
        s = FieldSolver(spark, GridSpec.of("144444", N), Kernel.CHAT_2, strategy="pencil", keep_green=False)
        return s.solve(_gridded(spark, sf)).select(*AXES, _round("v", 5).alias("v"))

    sql = f"""
WITH f AS ({_lineitem_sql()}), s AS (SELECT i0, i1, i2, v FROM f UNION ALL SELECT -1 - i0, i1, i2, -v FROM f),
p AS (SELECT a, b, c FROM range({N}) x(a), range({N}) y(b), range({N}) z(c)),
d AS (SELECT a, b, c, v, {_H!r} * sqrt(pow(a - i0, 2) + pow(b - i1, 2) + pow(c - i2, 2)) AS r FROM p, s)
SELECT {_INDEX}, {_sql_round(f"sum(v * {_H ** 3!r} * CASE WHEN r = 0 THEN -0.5 * pow(3 * {_H ** 3!r} / (4 * pi()), 2.0/3) / {_H ** 3!r} ELSE -1 / (4 * pi() * CASE WHEN r = 0 THEN 1 ELSE r END) END)", 5)} AS v FROM d GROUP BY a, b, c
"""
    return run, sql


MEASURES = ("l_quantity", "l_discount", "l_tax")


def _rotational(diff: Diff, strategy: str, digits: int = 5):
    def run(spark, sf):
        s = FieldSolver(spark, GridSpec.of("333333", N, components=3), Kernel.CHAT_2, Equation.ROT, diff, strategy=strategy, keep_green=False)
        return s.solve(_gridded(spark, sf, MEASURES)).select("comp", *AXES, _round("v", 5).alias("v"))

    weights = {Diff.SPE: None, Diff.FD2: (1.0,), Diff.FD4: (4 / 3, -1 / 6), Diff.FD6: (3 / 2, -3 / 10, 1 / 30)}[diff]
    kappa = lambda k: k if weights is None else "(" + " + ".join(f"{w!r}::DOUBLE * sin({k} * {m * _H!r}) / {_H!r}" for m, w in enumerate(weights, 1)) + ")"
    theta = f"2 * pi() * (e0 * d0 + e1 * d1 + e2 * d2) / {N}"
    sums = ", ".join(f"-sum(wt * {kappa(f'k{a}')} * sin({theta}) * -1.0 / (k0*k0 + k1*k1 + k2*k2)) / {N ** 3} AS g{a}" for a in range(3))
    join = lambda c, g: f"SELECT a, b, c, sum(v * {g}) AS v FROM p, f JOIN g ON TRUE WHERE f.comp = {c} AND g.d0 = (a - i0 + {N}) % {N} AND g.d1 = (b - i1 + {N}) % {N} AND g.d2 = (c - i2 + {N}) % {N} GROUP BY a, b, c"
    terms = " UNION ALL ".join(
        f"SELECT {to} AS comp, a, b, c, v FROM ({join(c1, f'g{a1}')}) UNION ALL SELECT {to}, a, b, c, -v FROM ({join(c2, f'g{a2}')})"
        for to, (a1, c1, a2, c2) in enumerate(((1, 2, 2, 1), (2, 0, 0, 2), (0, 1, 1, 0)))
    )
    sql = f"""
WITH f AS ({_lineitem_sql(MEASURES)}), p AS (SELECT a, b, c FROM range({N}) x(a), range({N}) y(b), range({N}) z(c)),
m AS (SELECT e0, e1, e2, CASE WHEN e0 IN (0, {N // 2}) THEN 1 ELSE 2 END AS wt, 2 * pi() * e0 AS k0, 2 * pi() * CASE WHEN e1 > {N // 2} THEN e1 - {N} ELSE e1 END AS k1,
  2 * pi() * CASE WHEN e2 > {N // 2} THEN e2 - {N} ELSE e2 END AS k2 FROM range({N // 2 + 1}) x(e0), range({N}) y(e1), range({N}) z(e2) WHERE e0 + e1 + e2 > 0),
g AS (SELECT d0, d1, d2, {sums} FROM m, range({N}) x(d0), range({N}) y(d1), range({N}) z(d2) GROUP BY d0, d1, d2)
SELECT CAST(comp AS INTEGER) AS comp, {_INDEX}, {_sql_round('sum(v)', digits)} AS v FROM ({terms}) GROUP BY comp, a, b, c
"""
    return run, sql


def _hourly(spark, sf):
    grid = GridSpec(n=(24, 1, 1), bc=((3, 3), (3, 3), (9, 9)))
    s = FieldSolver(spark, grid, Kernel.CHAT_2, strategy="pencil")
    return s.solve(hourly(spark.read.parquet(f"{sf}/events.parquet"))).select("i0", _round("v", 4).alias("v"))


_HOURLY_SQL = f"""
WITH f AS (SELECT hour(ts) AS j, sum(value) AS v FROM events GROUP BY 1),
g AS (SELECT d, sum(CASE WHEN m = 12 THEN 1 ELSE 2 END * cos(2 * pi() * m * d / 24) * -1 / pow(2 * pi() * m, 2)) / 24 AS g FROM range(24) a(d), range(1, 13) b(m) GROUP BY d)
SELECT CAST(i AS INTEGER) AS i0, {_sql_round('sum(v * g)', 4)} AS v FROM range(24) p(i), f JOIN g ON TRUE WHERE g.d = (i - j + 24) % 24 GROUP BY i
"""


def _minutes(spark, sf):
    """Half of the modes of all events by minute: one line of tens of thousands of points, in two short transforms."""
    line, n = by_minute(spark.read.parquet(f"{sf}/events.parquet"))
    y = longline.dft(line, n, panel=1 << 13).where(F.col("k") <= n // 2)
    return y.select("k", _round("re", 3).alias("re"), _round("im", 3).alias("im"))


_MINUTES_SQL = f"""
WITH s AS (SELECT date_trunc('day', min(ts)) AS first, 1440 * (1 + date_diff('day', min(ts), max(ts))) AS n FROM events),
f AS (SELECT CAST(floor(epoch(ts - first) / 60) AS BIGINT) AS j, any_value(n) AS n, sum(value) AS v FROM events, s GROUP BY 1),
k AS (SELECT unnest(range(n // 2 + 1)) AS k FROM s),
t AS (SELECT k, v, 2 * pi() * ((k * j) % n) / n AS t FROM k, f)
SELECT k, {_sql_round('sum(v * cos(t))', 3)} AS re, {_sql_round('-sum(v * sin(t))', 3)} AS im FROM t GROUP BY k
"""


def _shared(spark: SparkSession, name: str) -> str:
    """A fresh path on the folder that all executors share; a temporary one only where there is a single machine."""
    folder, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not folder:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return f"{folder.rstrip('/')}/gridloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _raw_round_trip(spark, sf):
    """The gridded table in a raw file of parts on the shared folder, and read back in byte ranges."""
    path = _shared(spark, "raw")
    raw.write(_gridded(spark, sf), path, (N, N, N), part_bytes=N * N * 16)
    return raw.read(spark, path, split_bytes=1000).select(*AXES, _round("v", 4).alias("v"))


def _stored_round_trip(spark, sf):
    """Three measures of the gridded table, stored and read back."""
    path = _shared(spark, "field")
    files.write_field(_gridded(spark, sf, MEASURES), path)
    return files.read_field(spark, path).select("comp", *AXES, _round("v", 4).alias("v"))


def _checked(spark, sf):
    """A solve that refuses values that are not numbers."""
    s = FieldSolver(spark, GridSpec.of("333311", N), Kernel.CHAT_2, strategy="slab")
    return s.solve(_gridded(spark, sf), check=True).select(*AXES, _round("v", 5).alias("v"))


def _gathered(spark, sf):
    """A solve of lines that are gathered along its first axis already."""
    grid = GridSpec.of("003311", N)
    lines = layout.to_lines(layout.normalise(_gridded(spark, sf)), grid.order[0])
    return FieldSolver(spark, grid, Kernel.CHAT_2, strategy="pencil").solve(lines).select(*AXES, _round("v", 5).alias("v"))


def _many(spark, sf):
    """A field for each line number of an order, all solved in one job, each in a task of its own."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    cells = [F.pmod(F.col(c), F.lit(N)).cast("int").alias(a) for a, c in zip(AXES, ("l_partkey", "l_suppkey", "l_orderkey"))]
    fields = items.groupBy(F.col("l_linenumber").cast("long").alias("rhs_id"), *cells).agg(F.sum("l_quantity").alias("v"))
    s = FieldSolver(spark, GridSpec.of("001133", N), Kernel.HEJ_6, strategy="local")
    return s.solve(fields).select("rhs_id", *AXES, _round("v", 5).alias("v"))


def _blocks_round_trip(spark, sf):
    """A solve from blocks to blocks."""
    grid = GridSpec.of("001101", N)
    field = blocks.to_blocks(_gridded(spark, sf), grid)
    return blocks.from_blocks(blocks.solve(grid, field, Kernel.CHAT_2), grid).select(*AXES, _round("v", 5).alias("v"))


# -- generated fields and norms ---------------------------------------------------------------


def weighted(field: DataFrame, spark, sf, digits: int = 4) -> DataFrame:
    """A generated field at the points of the gridded table, times its values."""
    data = _gridded(spark, sf).select(*AXES, F.col("v").alias("w"))
    keys = [c for c in ("comp", *AXES) if c in field.columns]
    return field.join(data, list(AXES)).select(*keys, _round(F.col("v") * F.col("w"), digits).alias("v"))


def weighted_sql(sql: str, digits: int = 4, plane: bool = False) -> str:
    """``sql`` gives a, b, c, v and perhaps comp, unrounded."""
    comp = "CAST(g.comp AS INTEGER) AS comp, " if "comp" in sql else ""
    return f"WITH w AS ({_lineitem_sql()}), g AS ({sql}) SELECT {comp}{_INDEX}, {_sql_round('g.v * w.v', digits)} AS v FROM g JOIN w ON a = i0 AND b = i1 AND c = i2"


def _generated(which: str):
    def run(spark, sf):
        return weighted(field_frame(spark, GridSpec.of("330144", N), which).drop("comp"), spark, sf)

    bump = "CASE WHEN q < 1 THEN exp(10 * (1 - 1 / (1 - CASE WHEN q < 1 THEN q ELSE 0 END))) ELSE 0 END"
    curve = f"CASE WHEN q < 1 THEN {bump} * 20 * (18 * q + 3 * q * q - 1) / pow(q - 1, 4) / 0.25 ELSE 0 END"
    value = f"sin(2 * pi() * x) * cos(2.5 * pi() * y) * {bump}"
    rhs = f"-4 * pi() * pi() * {value} - 6.25 * pi() * pi() * {value} + sin(2 * pi() * x) * cos(2.5 * pi() * y) * ({curve})"
    sql = f"SELECT a, b, c, {value if which == 'solution' else rhs} AS v FROM (SELECT a, b, c, (a + 0.5::DOUBLE) / {N} AS x, (b + 0.5::DOUBLE) / {N} AS y, pow(((c + 0.5::DOUBLE) / {N} - 0.5) / 0.5, 2) AS q FROM range({N}) r0(a), range({N}) r1(b), range({N}) r2(c))"
    return run, weighted_sql(sql)


def _vortex(which: str):
    def run(spark, sf):
        return weighted(vortex_tube(spark, GridSpec.of("444433", N, components=3), 2, 0.1, mirror=(-1, 1), which=which), spark, sf)

    s2 = 0.01
    images = "(VALUES (0.5, 0.5, 1.0), (1.5, 0.5, -1.0), (0.5, 1.5, 1.0), (1.5, 1.5, -1.0)) t(ca, cb, s)"
    w = f"exp(r2 / {-2 * s2!r}) / (2 * pi() * {s2!r})"
    u = f"CASE WHEN r2 > 0 THEN (1 - exp(r2 / {-2 * s2!r})) / (2 * pi() * CASE WHEN r2 > 0 THEN r2 ELSE 1 END) ELSE 1 / (4 * pi() * {s2!r}) END"
    v = f"CASE WHEN comp = 2 THEN sum(-s * {w}) ELSE 0 END" if which == "rhs" else f"CASE comp WHEN 0 THEN sum(-s * db * {u}) WHEN 1 THEN sum(s * da * {u}) ELSE 0 END"
    sql = f"""SELECT comp, a, b, c, {v} AS v FROM (
SELECT comp, a, b, c, s, (a + 0.5::DOUBLE) / {N} - ca AS da, (b + 0.5::DOUBLE) / {N} - cb AS db, pow((a + 0.5::DOUBLE) / {N} - ca, 2) + pow((b + 0.5::DOUBLE) / {N} - cb, 2) AS r2
FROM range(3) r(comp), range({N}) r0(a), range({N}) r1(b), range({N}) r2(c), {images}) GROUP BY comp, a, b, c"""
    return run, weighted_sql(sql)


def _norms(spark, sf):
    grid, path = GridSpec.of("333333", N), _shared(spark, "field")
    files.write_field(_gridded(spark, sf), path)  # read three times
    f = files.read_field(spark, path)
    u = FieldSolver(spark, grid, Kernel.CHAT_2, strategy="pencil").solve(f)
    e = analysis.error_norms(f, f.withColumn("v", F.col("v") * 2), grid)
    s = analysis.summary(u, grid)
    return e.join(s, ["rhs_id", "comp"]).select(_round("err_l2", 4).alias("err_l2"), _round("err_inf", 4).alias("err_inf"), _round("v_mean", 4).alias("v_mean"))


_NORMS_SQL = f"WITH f AS ({_lineitem_sql()}) SELECT {_sql_round(f'sqrt(sum(v * v) * {_H ** 3!r})', 4)} AS err_l2, {_sql_round('max(abs(v))', 4)} AS err_inf, 0.0::DOUBLE AS v_mean FROM f"


def _convergence(spark, sf):
    """Orders of kernels: distance of each one's solution from the singular kernel's, of the gridded table at two resolutions."""
    rows = None
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    for n in (8, 16):
        f, grid = lineitem_grid(items, n), GridSpec.of("003333", n)
        exact = FieldSolver(spark, grid, Kernel.CHAT_2, strategy="slab").solve(f)
        for kernel in (Kernel.LGF_2, Kernel.HEJ_4, Kernel.MEHR_4F):
            e = analysis.error_norms(FieldSolver(spark, grid, kernel, strategy="slab").solve(f), exact, grid)
            e = e.select(F.lit(kernel.name).alias("kernel"), F.lit(n).alias("n"), F.col("err_inf").alias("err"))
            rows = e if rows is None else rows.unionByName(e)
    return analysis.convergence(rows).select("kernel", "n", _round("err", 6).alias("err"), _round("order", 3).alias("order"))


def _forward_backward(spark, sf):
    """Transforms alone, there and back, on distributed lines."""
    grid = GridSpec.of("330011", N)
    y = transform.forward(grid, layout.normalise(_gridded(spark, sf)))
    u = transform.backward(grid, y)
    return u.select(*AXES, _round(F.col("re") * grid.normfact, 5).alias("v"))


_FORWARD_BACKWARD_SQL = f"WITH f AS ({_lineitem_sql()}) SELECT CAST(a AS INTEGER) AS i0, CAST(b AS INTEGER) AS i1, CAST(c AS INTEGER) AS i2, {_sql_round('coalesce(v, 0)', 5)} AS v FROM range({N}) x(a) CROSS JOIN range({N}) y(b) CROSS JOIN range({N}) z(c) LEFT JOIN f ON i0 = a AND i1 = b AND i2 = c"


def _build() -> dict[str, tuple]:
    out: dict[str, tuple] = {"solve_periodic": _solve("333333", Kernel.CHAT_2, "slab")}
    for name in BASIS:
        out[f"embedding_{name}"] = _real(name)
        out[f"embedding_{name}_round_trip"] = _round_trip(name)
    out["embedding_dft"] = (_dft, _DFT_SQL)
    out["embedding_dft_round_trip"] = (_dft_round_trip, f"{_POINTS} SELECT vec_id, j, {_sql_round('x')} AS x FROM e")
    out["embedding_dct2_columns"] = (_basis_columns, out["embedding_dct2"][1])
    out["axis_plans"] = (_plans, _plans_sql())
    out["mirrored_index"] = (_mirrored, _MIRRORED_SQL)
    out["linear_index"] = (_linear_index, _linear_sql())
    for kernel in Kernel:
        out[f"green_spectral_{kernel.name.lower()}"] = _solve("003301", kernel, "pencil")
    out["solve_walls"] = _solve("001101", Kernel.CHAT_2, "pencil")
    out["solve_mixed_walls"] = _solve("330010", Kernel.LGF_4, "slab")
    out["solve_compact"] = _solve("113333", Kernel.MEHR_6F, "pencil")
    out["solve_regularised"] = _solve("003311", Kernel.HEJ_4, "pencil")
    out["solve_filtered"] = _solve(
        "333333", Kernel.CHAT_2, "pencil", lambda k0, k1, k2, re, im: tuple(x * F.exp((k0 * k0 + k1 * k1 + k2 * k2) * -0.01) for x in (re, im)), "exp(-0.01 * (k0*k0 + k1*k1 + k2*k2))"
    )
    out["solve_free"] = _free("pencil")
    out["solve_free_distributed"] = _free("slab")
    out["solve_half_free"] = _half_free()
    for diff in (Diff.SPE, Diff.FD2, Diff.FD4, Diff.FD6):
        out[f"solve_rotational_{diff.name.lower()}"] = _rotational(diff, "pencil" if diff != Diff.FD4 else "slab")
    out["solve_hourly"] = (_hourly, _HOURLY_SQL)
    out["events_by_minute_modes"] = (_minutes, _MINUTES_SQL)
    out["field_raw_round_trip"] = (_raw_round_trip, f"WITH f AS ({_lineitem_sql()}) SELECT CAST(a AS INTEGER) AS i0, CAST(b AS INTEGER) AS i1, CAST(c AS INTEGER) AS i2, {_sql_round('coalesce(v, 0)', 4)} AS v FROM range({N}) x(a) CROSS JOIN range({N}) y(b) CROSS JOIN range({N}) z(c) LEFT JOIN f ON i0 = a AND i1 = b AND i2 = c")
    out["field_stored_round_trip"] = (_stored_round_trip, f"SELECT CAST(comp AS INTEGER) AS comp, CAST(i0 AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1, CAST(i2 AS INTEGER) AS i2, {_sql_round('v', 4)} AS v FROM ({_lineitem_sql(MEASURES)})")
    out["solve_checked"] = (_checked, _expansion_sql("333311", Kernel.CHAT_2))
    out["solve_gathered_lines"] = (_gathered, _expansion_sql("003311", Kernel.CHAT_2))
    many = f"SELECT CAST(l_linenumber AS BIGINT) AS rhs_id, l_partkey % {N} AS i0, l_suppkey % {N} AS i1, l_orderkey % {N} AS i2, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
    out["solve_each_line_number"] = (_many, _expansion_sql("001133", Kernel.HEJ_6, source=many, key="rhs_id"))
    out["solve_walls_blocks"] = (_blocks_round_trip, out["solve_walls"][1])
    out["field_rhs"], out["field_solution"] = _generated("rhs"), _generated("solution")
    out["vortex_vorticity"], out["vortex_velocity"] = _vortex("rhs"), _vortex("solution")
    out["error_norms"] = (_norms, _NORMS_SQL)
    out["forward_backward"] = (_forward_backward, _FORWARD_BACKWARD_SQL)
    out["convergence_orders"] = (_convergence, None)
    return out


def _all() -> dict[str, tuple]:
    from gridloom import kernel_queries

    return _build() | kernel_queries.build()


def queries() -> dict:
    return {k: run for k, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
