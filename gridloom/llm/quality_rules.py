"""Quality rules with risk-controlled cutoffs.  DataFrame functions only.

Each rule rejects a text when a statistic exceeds a cutoff.  For every stratum (language)
and rule, a fixed grid of cutoffs is walked from lenient to strict over the labelled good
documents; a cutoff is certified when the exact binomial tail P[Bin(n, alpha) <= false
rejections] stays below delta divided by the number of (stratum, rule) families, and the
walk ends at the first cutoff that is not certified (fixed-sequence testing).  With
probability 1 - delta no rule then rejects more than alpha of the good documents of any
stratum; the alphas of the rules add up to ``RISK``.

Defined results
---------------
* Null or wordless text has all counts 0 and fails the base rule (under 50 words).
* A null language is a stratum of its own; a stratum with too few labels keeps the most
  lenient behaviour, no cutoff at all.
* Labels that repeat a ``doc_id`` count once; null labels and labels of unknown documents do not count.
* Repeated rows are judged alike, an empty table gives an empty result, and clashing extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.runtime import materialise

MIN_WORDS = 50
MAX_REPEAT = 50  # percent of words in repeated 3-word windows

#: total share of good documents that the certified rules may reject, and the error probability
RISK = 0.05
DELTA = 0.05
#: statistic -> cutoffs from lenient to strict
GRID = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03),
    "mark_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03),
    "upper_share": (0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1),
    "dup_line_share": (0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_share": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05),
}
#: strata whose cutoffs may be broadcast; beyond it the join shuffles (and AQE splits a hot stratum)
BROADCAST_STRATA = 10_000

_SPACES = r"[ \t\n\x0B\f\r]+"
_WORD = r"[^ \t\n\x0B\f\r]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, characters: str) -> Column:
    """Number of characters of a class in a text."""
    return F.regexp_count(text, F.lit(characters)).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more (windows compare by 64-bit hash)."""

    def covered(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def runs(k: Column) -> Column:
            last = F.size(k) - 1
            twin = F.filter(
                F.transform(
                    k,
                    lambda x, j: F.when(
                        ((j > 0) & (F.get(k, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(k, j + 1)["h"] == x["h"])), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.aggregate(
                F.sort_array(twin),
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")),
            )["n"]

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(_let(ordered, runs))

    def of(w: Column) -> Column:
        n = F.size(w)
        keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.when(n < 3, F.lit(0)).otherwise(_let(keys, covered)).cast("long").alias("n_repeat_words"))

    return _let(words, of)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACES), "")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` plus one struct column ``__gl_q`` of base and method statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    raw = F.struct(
        _repeat_words(_words(text)).alias("w"),
        line_counts.alias("l"),
        _count(text, r"[#*$%&|<>]").alias("n_symbols"),
        _count(text, r"[!?]").alias("n_marks"),
        _count(text, r"[A-Z]").alias("n_upper"),
    )

    def final(r: Column) -> Column:
        n, chars_ = r["w"]["n_words"], r["w"]["word_chars"]
        share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        return F.struct(
            n.alias("n_words"), chars_.alias("word_chars"), r["n_symbols"].alias("n_symbols"), r["l"]["dup"].alias("n_dup_lines"),
            r["w"]["n_repeat_words"].alias("n_repeat_words"),
            ((n < MIN_WORDS) | (100 * r["w"]["n_repeat_words"] > MAX_REPEAT * n)).alias("base_failed"),
            share(r["n_symbols"], chars_).alias("symbol_share"), share(r["n_marks"], chars_).alias("mark_share"),
            share(r["n_upper"], chars_).alias("upper_share"), share(r["l"]["dup"], r["l"]["n"]).alias("dup_line_share"),
            share(r["w"]["n_repeat_words"], n).alias("repeat_share"),
        )

    return docs.withColumn("__gl_q", _let(raw, final))


def binomial_tail(k: Column, n: Column, alpha: float) -> Column:
    """P[Bin(n, alpha) <= k] by its exact sum in logarithms; 1 where k >= n * alpha, far from any significance."""
    odds = F.lit(alpha / (1 - alpha))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    first = n * F.log(F.lit(1 - alpha))
    seq = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(seq, F.struct(first.alias("term"), first.alias("total")), step, lambda a: F.exp(a["total"]))
    return F.when((n == 0) | (k >= n * alpha), F.lit(1.0)).otherwise(total)


def certify(stats: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the strictest certified cutoff of each family that has one.

    ``stats`` holds doc_id, the stratum and the statistics of ``GRID``."""
    alpha = risk / len(GRID)
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    held = stats.join(good, F.col("doc_id") == F.col("_id"))
    counts = [F.sum((F.col(r) > t).cast("long")).alias(f"{r}_{j}") for r, ts in GRID.items() for j, t in enumerate(ts)]
    per = held.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *counts)
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(j).alias("step"), F.lit(float(t)).alias("t"), F.col(f"{r}_{j}").alias("k")) for r, ts in GRID.items() for j, t in enumerate(ts)))
    per = per.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))  # counted before the rows multiply
    walk = per.select("stratum", "n", "strata", F.explode(rows).alias("x")).select("stratum", "n", "strata", "x.*")
    walk = walk.withColumn("p", binomial_tail(F.col("k"), F.col("n"), alpha))
    ok = (F.col("p") <= F.lit(delta) / (F.col("strata") * len(GRID))).cast("int")
    family = Window.partitionBy("stratum", "rule").orderBy("step")
    walk = walk.withColumn("ok", F.min(ok).over(family))
    return walk.where("ok = 1").groupBy("stratum", "rule").agg(F.min("t").alias("cutoff"))


def verdicts(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``stats`` (with ``__gl_q``) and a column ``__gl_kept``: true for texts that pass the base rule and every
    certified cutoff of their stratum."""
    table = cutoffs.groupBy(F.col("stratum").alias("__gl_s")).agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__gl_{r}") for r in GRID))
    table = materialise(table, "quality-cutoffs")
    small = table.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    out = stats.join(F.broadcast(table) if small else table, F.col(stratum).eqNullSafe(F.col("__gl_s")), "left")
    fail = F.col("__gl_q.base_failed")
    for r in GRID:
        fail = fail | F.coalesce(F.col(f"__gl_q.{r}") > F.col(f"__gl_{r}"), F.lit(False))
    return out.withColumn("__gl_kept", ~fail).drop("__gl_s", *(f"__gl_{r}" for r in GRID))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base statistics, base_failed and kept for every row."""
    stats = materialise(with_statistics(docs.select("doc_id", "text", "lang")).select("doc_id", "lang", "__gl_q"), "quality-stats")
    q = [F.col(f"__gl_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return verdicts(stats, certify(stats.select("doc_id", "lang", "__gl_q.*"), labels)).select("doc_id", *q, F.col("__gl_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass; columns unchanged.  Cutoffs are certified on this input, whose rows are stored
    once beside their statistics: those cost far more than a copy does."""
    stats = materialise(with_statistics(docs), "quality-stats")
    kept = verdicts(stats, certify(stats.select("doc_id", "lang", "__gl_q.*"), labels)).where("__gl_kept")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
