"""Index operators and the move between long rows and lines.

Long fields have one row per point: ``rhs_id, comp, i0, i1, i2, v``; spectra have ``re, im``
instead of ``v``.  A line table has one row per line along an axis: the other keys and an
unordered ``pts`` array of (place, re, im).  Missing points read as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.spec import GridSpec

AXES = ("i0", "i1", "i2")
KEYS = ("rhs_id", "comp", *AXES)
FIELD = "rhs_id long, comp int, i0 int, i1 int, i2 int, v double"
SPECTRUM = "rhs_id long, comp int, i0 int, i1 int, i2 int, re double, im double"


def normalise(df: DataFrame) -> DataFrame:
    """A field or spectrum with all key columns; a missing ``rhs_id`` or ``comp`` is 0."""
    have = set(df.columns)
    keys = [(F.col(k) if k in have else F.lit(0)).cast("long" if k == "rhs_id" else "int").alias(k) for k in KEYS]
    if "v" in have:
        return df.select(*keys, F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    return df.select(*keys, "re", "im")


def checked(df: DataFrame) -> DataFrame:
    """The field itself; a value that is null or not a number fails the job that reads it."""
    bad = [c for c in ("v", "re", "im") if c in df.columns]
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.raise_error(F.lit(f"{c} holds NaN or null")).cast("double")).otherwise(F.col(c)) for c in bad})


def sym_id(e: Column, symstart: float, signed: bool = True) -> Column:
    """Index mirrored beyond ``symstart`` (0: never)."""
    if not symstart:
        return e
    back = F.greatest(F.floor(F.abs(F.lit(2 * symstart) - e)).cast("int"), F.lit(1))
    return F.when(e <= symstart, e).otherwise(-back if signed else back)


def wave_number(grid: GridSpec, axis: int, e: Column) -> Column:
    p = grid.axes[axis]
    s = p.symstart(grid.half(axis))
    e = F.when(e > s, e - p.padded).otherwise(e) if s else e
    return (e + F.lit(p.koffset)) * F.lit(p.kfact)


def position(grid: GridSpec, axis: int, e: Column) -> Column:
    p = grid.axes[axis]
    return (e + F.lit(0.5 if p.cell else 0.0)) * F.lit(p.h)


def index_table(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """i0, i1, i2 of every point, by arithmetic on one range (first axis fastest)."""
    n0, n1, n2 = shape
    df = spark.range(n0 * n1 * n2)
    return df.select(
        F.pmod("id", F.lit(n0)).cast("int").alias("i0"),
        F.pmod(F.floor(F.col("id") / n0), F.lit(n1)).cast("int").alias("i1"),
        F.floor(F.col("id") / (n0 * n1)).cast("int").alias("i2"),
    )


def collapsed(shape: tuple[int, int, int], i0: Column, i1: Column, i2: Column) -> Column:
    """Linear index, first axis fastest."""
    return i0 + F.lit(shape[0]) * (i1 + F.lit(shape[1]) * i2)


def to_lines(df: DataFrame, axis: int) -> DataFrame:
    """Gather the lines along ``axis``: the one exchange of a transform."""
    rest = [k for k in KEYS if k != AXES[axis]]
    return df.groupBy(*rest).agg(F.collect_list(F.struct(F.col(AXES[axis]).alias("i"), "re", "im")).alias("pts"))


def box(df: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Points of a sub-box, bounds included."""
    keep = F.lit(True)
    for a, lo, hi in zip(AXES, low, high):
        keep = keep & F.col(a).between(lo, hi)
    return df.where(keep)


def shift(df: DataFrame, by: tuple[int, int, int]) -> DataFrame:
    """Move all points by constant offsets."""
    return df.withColumns({a: (F.col(a) + b).cast("int") for a, b in zip(AXES, by) if b})
