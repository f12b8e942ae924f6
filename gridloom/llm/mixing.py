"""Mixing sources to target weights: every document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy with probability equal to the fraction.  DataFrame functions only.

Defined results
---------------
* Size is the number of words ``[^\\x20\\x09-\\x0D]+``; null or empty text has size 0.
* Sources rank by code point, null last (a null source is a source of its own); they weigh
  5, 2, 1, repeating, and share ``budget`` percent of all sizes.  No target exceeds ``cap``
  times its source's size; the excess is reshared by weight.
* Rows are treated one by one, so repeated rows each get their own copies (the same number);
  an empty table gives an empty result.  Extra input columns are ignored.
* The Bernoulli hash is the md5 of the document id and a seed.  Of ``SEEDS`` fixed seeds each source uses
  the one whose total comes nearest its target, found in one aggregation over (source, size),
  so that a few long documents do not push a source off its target.  Under any one seed a copy has exactly
  the fraction as its probability; the choice keeps that on average over a source of many documents, while a
  source of a few is in effect rounded to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.runtime import materialise

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
SEEDS = 32
#: sources whose table may be broadcast; beyond it the join shuffles (and AQE splits a hot source)
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null gives 0."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def _uniform(key: Column, seed: int) -> Column:
    """[0, 1) from the first 13 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` in ``order`` with running ``sums`` that include the row itself, without bringing all rows together:
    ranges of the order are summed side by side, and each takes what the ranges before it hold (one row a range)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    held = placed.groupBy("_range").agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_range", *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(held), "_range")  # as many rows as shuffle partitions
    return out.select(*rows.columns, *((F.sum(v).over(inside) + F.col(f"_{k}")).alias(k) for k, v in sums.items()))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for (source, size) rows, by filling all sources in
    proportion to their weights until each is full or the budget is spent."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = _running(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full", CAP * F.col("source_size"))
    # sources fill up in order of full / weight; before the k-th is full, the level is (budget - full ones) / weight of the rest
    rising = [(F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    per = _running(per, rising, {"through": F.col("full"), "heavy": F.col("weight")})
    all_size, all_weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    before, left = F.col("through") - F.col("full"), F.lit(all_weight) - F.col("heavy") + F.col("weight")
    per = per.withColumn("level", (F.lit(BUDGET * float(all_size or 0)) - before) / left)
    # the first source that need not be full sets the level; later rows give lower ones
    water = per.agg(F.max(F.when(F.col("full") >= F.col("level") * F.col("weight"), F.col("level")))).first()[0]
    target = F.col("full") if water is None else F.least(F.col("full"), F.lit(water) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _attach(docs: DataFrame, table: DataFrame) -> DataFrame:
    small = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = table.withColumnRenamed("source", "_source")
    return docs.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def plan(docs: DataFrame) -> DataFrame:
    """source, source_size, target, rate and the seed each source uses (one row per source)."""
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return _plan(sizes)


def _plan(sizes: DataFrame) -> DataFrame:
    goal = materialise(targets(sizes), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("rate", rate)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    tried = _attach(sizes, goal).groupBy("source").agg(
        *(F.sum(F.col("size") * copies(key, F.lit(None), s)).alias(f"t{s}") for s in range(SEEDS)), F.first("target").alias("goal")
    )
    off = F.array(*(F.struct(F.abs(F.col(f"t{s}") - F.col("goal")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)))
    best = tried.select(F.col("source").alias("_s"), F.array_min(off)["seed"].alias("seed"))
    return materialise(goal.join(best, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-plan")


def copies(key: Column, seed: Column, fixed: int | None = None) -> Column:
    """floor(rate) plus the Bernoulli copy; ``fixed`` names one seed, else ``seed`` is a column."""
    whole = F.floor("rate")
    if fixed is not None:
        u = _uniform(key, fixed)
    else:
        u = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), seed.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (whole + (u < F.col("rate") - whole).cast("long")).cast("long")


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, one row per row of ``docs``."""
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    out = _attach(sizes, _plan(sizes))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(key, F.col("seed"))).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as the mix takes it, same columns."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    table = plan(docs)
    body = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source")
    many = F.sequence(F.lit(1), copies(key, F.col("seed")).cast("int"))
    out = _attach(body, table).withColumn("n", copies(key, F.col("seed"))).where("n > 0").withColumn("copy", F.explode(many))
    return out.select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
q AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS fill FROM p
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(fill) OVER (ORDER BY fill / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY fill / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q
), t AS (
  SELECT source, source_size, least(fill, coalesce((max(CASE WHEN fill >= level * weight THEN level END) OVER ()) * weight, fill)) AS target FROM l
), r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (
  SELECT d.doc_id, d.size, r.*, s.seed, d.size * CAST(floor(rate) + CASE WHEN
    CAST('0x' || md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || s.seed)[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range(32) s(seed)
), best AS (
  SELECT source, arg_min(seed, abs(total - target) * 1000000 + seed / 1000.0) AS seed
  FROM (SELECT source, seed, sum(taken) AS total, any_value(target) AS target FROM c GROUP BY source, seed) GROUP BY source
)
SELECT c.doc_id, c.size, c.source_size, c.target, c.taken FROM c JOIN best ON c.source IS NOT DISTINCT FROM best.source AND c.seed = best.seed
"""
