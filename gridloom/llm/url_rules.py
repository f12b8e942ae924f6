"""URL filters: fixed host/path rules, then association rules mined from labelled URLs.
DataFrame and SQL functions and Spark ML's FP-growth only.

Defined results
---------------
* Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or
  the end.  Null urls and urls without ``://`` have empty host and path, no rule and the verdict of the mined rules on no tokens: allow.
* Labels that repeat a page count once per distinct label; null labels and unknown pages do not count.
* The query learns from the fixed rules' own decisions, block against allow, on the urls that they decide, and judges
  the others: a host most of whose decided urls are blocked is blocked for the rest of its urls too.  Tokens that the
  fixed rules are made of are left out, as those rules say already when they count.
* Without labels, or when no combination is frequent and confident enough, everything no rule fits is allowed.
* Repeated rows are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.runtime import materialise

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

BAD = "label:bad"
#: bad labelled urls that a combination must have at least, in a table of any size
MIN_URLS = 30
MIN_CONFIDENCE = 0.7
MIN_LIFT = 1.5
#: lift over the share of blocked urls among decided ones: that share is high, as fixed rules block more than they allow,
#: so no rule could reach ``MIN_LIFT``
DECIDED_LIFT = 1.1


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host, its suffixes, its labels and their hyphenated words, and path words with digits folded."""
    labels = F.array_remove(F.split(host, r"\."), "")
    n = F.size(labels)
    suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, n), ".")))).otherwise(F.array())
    words = F.array_remove(F.split(F.regexp_replace(path, "[0-9]+", "0"), "[/._\\-]+"), "")
    names = F.concat(labels, F.array_remove(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), ""))
    return F.array_distinct(F.concat(suffixes, F.transform(names, lambda x: F.concat(F.lit("l:"), x)), F.transform(words, lambda w: F.concat(F.lit("p:"), w))))


@dataclass
class MinedRules:
    """Token combinations that mark a url as bad: a list of them, or a table ``key, rest`` of any size that
    holds each one under one of its tokens."""

    combinations: DataFrame | list[tuple[str, ...]]

    def index(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.combinations, DataFrame):
            return self.combinations
        return spark.createDataFrame([(c[0], list(c[1:])) for c in self.combinations], "key string, rest array<string>")

    def matched(self, sets: DataFrame) -> DataFrame:
        """The distinct token sets of ``sets(_tokens)`` that hold all tokens of some combination."""
        held = sets.distinct().select("_tokens", F.explode("_tokens").alias("key")).join(self.index(sets.sparkSession), "key")
        return held.where(F.size(F.array_except("rest", "_tokens")) == 0).select("_tokens").distinct()


def _minimal(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, rest`` of the combinations ``sets(a)`` that contain no other one; the key is the rarest token."""
    rarest = sets.select("a", F.explode("a").alias("token")).join(counts, "token").groupBy("a").agg(F.min(F.struct("n", "token"))["token"].alias("key"))
    index = materialise(rarest.select("key", F.array_remove("a", F.col("key")).alias("rest"), "a"), "url-rules")
    shorter = index.select("key", F.col("rest").alias("_rest"))
    inside = index.select("a", F.explode("a").alias("key")).join(shorter, "key")
    inside = inside.where((F.size("_rest") + 1 < F.size("a")) & (F.size(F.array_except("_rest", "a")) == 0))
    return index.join(inside.select("a").distinct(), "a", "left_anti").select("key", "rest")


def _named(rules: DataFrame, names: DataFrame) -> DataFrame:
    """``rules(key, rest)`` with each token replaced by each of its ``names``: every choice is a rule."""
    rules = rules.withColumn("rule", F.monotonically_increasing_id())
    parts_ = rules.select("rule", F.posexplode(F.concat(F.array("key"), "rest")).alias("at", "token")).join(names, "token")
    ordered = parts_.groupBy("rule").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "names"))), lambda x: x["names"]).alias("choices"))
    empty = F.array(F.array().cast("array<string>"))
    every = F.aggregate("choices", empty, lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda x: F.array_append(d, x)))))
    return ordered.select(F.explode(every).alias("a")).select(F.col("a")[0].alias("key"), F.expr("slice(a, 2, size(a))").alias("rest"))


def decided(pages: DataFrame, rules=RULES) -> DataFrame:
    """items, bad: the tokens of every url that a fixed rule decides, and whether it blocks it."""
    host, path = parts(F.col("url"))
    rule = rule_for(host, path, rules)
    own = F.array_distinct(F.flatten(F.array(*(tokens(F.lit(h), F.lit(p)) for _, h, p in rules)))) if rules else F.array().cast("array<string>")
    rows = pages.select(F.array_except(tokens(host, path), own).alias("items"), (rule["verdict"] == "block").alias("bad"))
    return rows.where(F.col("bad").isNotNull() & (F.size("items") > 0))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """items, bad: the tokens of the urls that ``labels`` is about (its ``doc_id`` being a page); a page is bad when its
    label says low quality or toxic."""
    lab = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    lab = lab.select(F.col("doc_id").alias("_id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad")).distinct()
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", tokens(host, path).alias("items")).join(lab, F.col("page_id") == F.col("_id")).where(F.col("bad") | (F.size("items") > 0))
    return rows.select("items", "bad")


def mine(pages: DataFrame, labels: DataFrame | None = None) -> MinedRules:
    """Rules over the tokens of labelled urls: those of ``labels``, else those that the fixed rules decide.  Keeps
    every rule of enough support, confidence and lift that no shorter rule implies: first those of one token,
    then FP-growth, with a label item, over the tokens that are in enough bad urls and no rule by themselves.

    Tokens that occur in the same urls (a host and its first label) go through FP-growth as one, and the rules found
    are written out for each of them, so that names for one thing do not multiply the combinations."""
    rows, lift = (decided(pages), DECIDED_LIFT) if labels is None else (labelled(pages, labels), MIN_LIFT)
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("id"), "items", "bad"), "url-labels")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if n < MIN_URLS:
        return MinedRules([])
    share = F.col("bad") / F.col("n")
    marks = (F.col("bad") >= MIN_URLS) & (share >= MIN_CONFIDENCE) & (share * n >= lift * n_bad)
    exploded = rows.select("id", "bad", F.explode("items").alias("token"))
    # which urls a token is in, as two sums of their hashes
    prints = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(20,0)")).alias(f"p{k}") for k in (1, 2)]
    counts = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), *prints).where(F.col("bad") >= MIN_URLS)
    counts = materialise(counts, "url-tokens")
    found = counts.where(marks).select(F.col("token").alias("key"), F.array().cast("array<string>").alias("rest"))
    same = counts.where(~marks).groupBy("n", "bad", "p1", "p2").agg(F.min("token").alias("token"), F.sort_array(F.collect_set("token")).alias("names"))
    same = materialise(same, "url-names")
    rest = exploded.join(same.select("token"), "token").groupBy("id", "bad").agg(F.collect_set("token").alias("items"))
    rest = materialise(rest.select(F.when(F.col("bad"), F.array_append("items", BAD)).otherwise(F.col("items")).alias("items")), "url-items")
    if m := rest.count():
        # half a url less than the least count: the library rounds its product with the number of rows up
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (MIN_URLS - 0.5) / m)).fit(rest).freqItemsets
        sets = sets.select(F.array_sort(F.array_remove("items", BAD)).alias("a"), F.array_contains("items", BAD).alias("with"), "freq")
        sets = sets.groupBy("a").agg(F.max(F.when(~F.col("with"), F.col("freq"))).alias("n"), F.max(F.when(F.col("with"), F.col("freq"))).alias("bad"))
        short = _minimal(sets.where((F.size("a") > 0) & marks).select("a"), counts.select("token", "n"))
        found = found.unionByName(_named(short, same.select("token", "names")))
    found = materialise(found, "url-rules")
    return MinedRules([] if found.isEmpty() else found)


def judge(pages: DataFrame, mined: MinedRules, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    own = F.lit("allow")
    if not isinstance(mined.combinations, list) or mined.combinations:
        rows = rows.withColumn("_tokens", tokens(F.col("host"), F.col("path")))
        # stored before it is joined: a join of two plain exchanges can be split where one set of tokens has most urls
        matched = materialise(mined.matched(rows.where("_rule is null").select("_tokens")), "url-matches")
        rows = rows.join(matched.withColumn("_bad", F.lit(True)), "_tokens", "left")
        own = F.when(F.col("_bad"), F.lit("block")).otherwise(own)
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, mine(pages))
