"""Interaction of five text filters, audited over all orders by the edges of their lattice.

A filter's effect depends only on which filters came before it, not on their order, so a document contributes to 80
edges: one for each filter and each subset of the other four that may already have been applied.  Documents are first
counted by part and by the set of conditions they fail (32 sets), the counts go to the edges, and each of the 600
steps of the 120 orders is looked up as an edge of its lattice path.  The work on the lattice does not grow with the
documents.

Whether a text is identical to one of a smaller id is decided by its SHA-256: copies are counted by fingerprint, part
and label before they meet, so a text that most documents have is a few rows by then.

Defined results
---------------
* Null texts are empty; an empty text fails A, and E if a smaller id is empty too.  A null language is the part ''.
* Rows that repeat a ``doc_id`` are documents of their own; equal ids are not smaller, so a repeated row alone does not
  fail E.  A null ``doc_id`` is neither smaller nor larger than any.
* Labels that repeat a document count once: it is good, or toxic, if any of them says so.  Null labels do not count.
* All 600 steps of every part that has documents are there; without documents the result is empty.  Extra columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column, words: Column) -> Column:
    """Bits of the conditions A to D that a text with these words fails."""
    n = F.size(words)
    conditions = (
        n < 100,
        100 * F.size(F.array_distinct(words)) < 80 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    a, b, c, d = (F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(conditions))
    return a + b + c + d


def failing_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of A to E), n, good, toxic: how many documents fail just these conditions."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", "text", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"))
    rows = rows.select("doc_id", "part", failures(F.col("text"), F.col("words")).alias("failed"), F.unhex(F.sha2("text", 256)).alias("print"))
    rows = rows.groupBy("doc_id", "part", "failed", "print").agg(F.count(F.lit(1)).alias("n"))
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(*marks)
    rows = rows.join(marks, F.col("doc_id") == F.col("_id"), "left")
    key = ["print", "part", "failed", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), F.isnotnull("doc_id").alias("named")]
    held = rows.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    # the documents of the smallest id that has a text are its originals; all others that have an id fail E
    same = Window.partitionBy("print")
    held = held.withColumn("first", F.min(F.when(F.col("named"), F.col("least.doc_id"))).over(same))
    original = F.when(~F.col("named"), F.col("n")).when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    kinds = F.array(F.struct(F.col("failed"), original.alias("n")), F.struct(F.col("failed").bitwiseOR(1 << 4).alias("failed"), (F.col("n") - original).alias("n")))
    split = held.select("part", "good", "toxic", F.explode(kinds).alias("x")).where("x.n > 0").select("part", "good", "toxic", "x.failed", "x.n")
    return split.groupBy("part", "failed").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def edges(sets: DataFrame) -> DataFrame:
    """part, applied (bits), filter (its number) and the counts of the 80 edges of each part."""
    every = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for f in range(5) for s in range(32) if not s >> f & 1))
    rows = sets.select("part", "failed", "n", "good", "toxic", F.explode(every).alias("e")).select("part", "failed", "n", "good", "toxic", "e.applied", "e.filter")
    bit = F.expr("shiftleft(1, filter)")
    fails = F.col("failed").bitwiseAND(bit) != 0
    before = F.col("failed").bitwiseAND(F.col("applied")) != 0
    total = lambda condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(0))
    return rows.groupBy("part", "applied", "filter").agg(
        total(~before & ~fails).alias("kept"), total(~before & fails).alias("removed"), total(before & fails).alias("redundant"),
        total(F.col("failed") == bit).alias("unique_fails"), total(~before & fails, "good").alias("good_lost"), total(~before & fails, "toxic").alias("toxic_lost"),
    )


def paths(spark: SparkSession) -> DataFrame:
    """filter_order, step, applied, filter: the edges along each of the 120 orders."""
    orders = spark.createDataFrame([("".join(p),) for p in itertools.permutations(FILTERS)], "filter_order string")
    step = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    number = lambda c: F.instr(F.lit(FILTERS), c) - 1
    bits = F.expr(f"aggregate(sequence(0, 4), 0, (a, i) -> a + IF(i < step - 1, shiftleft(1, instr('{FILTERS}', substr(filter_order, i + 1, 1)) - 1), 0))")
    return step.select("filter_order", F.col("step").cast("int").alias("step"), bits.alias("applied"), number(F.expr("substr(filter_order, step, 1)")).cast("int").alias("filter"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = edges(failing_sets(docs, labels)).join(F.broadcast(paths(docs.sparkSession)), ["applied", "filter"])  # 600 rows
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))  # 120 steps a filter
    return steps.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), m AS (
  SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS s, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), p AS (
  SELECT x || y || z || u || v AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t2(y), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t3(z),
    (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t4(u), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t5(v) WHERE len(list_distinct([x, y, z, u, v])) = 5
), q AS (
  SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS own,
    (CASE WHEN s.A THEN 'A' ELSE '' END || CASE WHEN s.B THEN 'B' ELSE '' END || CASE WHEN s.C THEN 'C' ELSE '' END || CASE WHEN s.D THEN 'D' ELSE '' END || CASE WHEN s.E THEN 'E' ELSE '' END) AS fails,
    left(filter_order, step - 1) AS done
  FROM m, p, range(1, 6) r(step)
), r AS (
  SELECT *, contains(fails, own) AS hit, length(translate(done, fails, '')) < length(done) AS gone FROM (SELECT * FROM q)
), o AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, any_value(own) AS own,
    CAST(sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM o
"""
