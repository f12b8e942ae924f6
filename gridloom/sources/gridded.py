"""Fields gridded from relational tables: sums on a small grid, counted in one partially aggregated pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lineitem_grid(items: DataFrame, n: int = 8, measures: tuple[str, ...] = ("l_quantity",)) -> DataFrame:
    """rhs_id, comp, i0, i1, i2, v: sums of measures over buckets of part, supplier and order keys."""
    cells = [F.pmod(F.col(c), F.lit(n)).cast("int").alias(f"i{d}") for d, c in enumerate(("l_partkey", "l_suppkey", "l_orderkey"))]
    sums = [F.sum(F.col(m).cast("double")).alias(f"v{c}") for c, m in enumerate(measures)]
    wide = items.groupBy(*cells).agg(*sums)
    rows = F.array(*(F.struct(F.lit(c).alias("comp"), F.col(f"v{c}").alias("v")) for c in range(len(measures))))
    return wide.select(F.lit(0).cast("long").alias("rhs_id"), "i0", "i1", "i2", F.explode(rows).alias("r")).select("rhs_id", "r.comp", "i0", "i1", "i2", "r.v")


def hourly(events: DataFrame) -> DataFrame:
    """rhs_id, comp, i0, i1, i2, v: event values by hour of day (24 cells along the first axis)."""
    return events.groupBy(F.hour("ts").alias("i0")).agg(F.sum("value").alias("v")).select(
        F.lit(0).cast("long").alias("rhs_id"), F.lit(0).alias("comp"), "i0", F.lit(0).alias("i1"), F.lit(0).alias("i2"), "v"
    )


def by_minute(events: DataFrame) -> tuple[DataFrame, int]:
    """rhs_id, i, re of event values by minute since the first day's midnight, and the minutes of all days."""
    day = F.date_trunc("day", F.col("ts"))
    first, last = events.agg(F.min(day), F.max(day)).first()
    if first is None:
        return events.select(F.lit(0).cast("long").alias("rhs_id"), F.lit(0).cast("long").alias("i"), F.col("value").alias("re")).limit(0), 1440
    minute = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(first))) / 60)
    sums = events.where("ts is not null").groupBy(minute.alias("i")).agg(F.sum("value").alias("re"))
    return sums.select(F.lit(0).cast("long").alias("rhs_id"), "i", "re"), 1440 * ((last - first).days + 1)
