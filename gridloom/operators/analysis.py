"""Error norms, summaries and convergence orders of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.layout import AXES
from gridloom.plans.spec import GridSpec


def error_norms(solution: DataFrame, exact: DataFrame, grid: GridSpec) -> DataFrame:
    """rhs_id, comp, err_l2, err_inf of two fields; points that one side lacks read as 0."""
    keys = ["rhs_id", "comp", *AXES]
    joined = solution.withColumnRenamed("v", "a").join(exact.withColumnRenamed("v", "b"), keys, "full")
    e = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return joined.groupBy("rhs_id", "comp").agg(F.sqrt(F.sum(e * e) * F.lit(grid.volume)).alias("err_l2"), F.max(F.abs(e)).alias("err_inf"))


def relative_error(solution: DataFrame, exact: DataFrame) -> DataFrame:
    """rhs_id, comp, rel_l2: norm of the difference over the norm of the exact field."""
    keys = ["rhs_id", "comp", *AXES]
    joined = solution.withColumnRenamed("v", "a").join(exact.withColumnRenamed("v", "b"), keys)
    d = F.col("a") - F.col("b")
    return joined.groupBy("rhs_id", "comp").agg((F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("b") * F.col("b")))).alias("rel_l2"))


def summary(field: DataFrame, grid: GridSpec) -> DataFrame:
    """rhs_id, comp, v_min, v_max, v_mean and integral."""
    return field.groupBy("rhs_id", "comp").agg(
        F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), (F.sum("v") * F.lit(grid.volume)).alias("integral")
    )


def convergence(errors: DataFrame, by: str = "kernel") -> DataFrame:
    """Order between successive resolutions of (by, n, err) rows."""
    w = Window.partitionBy(by).orderBy("n")
    return errors.withColumn("order", F.log(F.lag("err").over(w) / F.col("err")) / F.log(F.col("n") / F.lag("n").over(w)))
