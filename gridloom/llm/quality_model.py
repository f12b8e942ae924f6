"""Quality classifier: a sparse rule ensemble compiled to Spark column expressions.

Statistics of whole texts are computed once per document.  Boosted regression trees over a
bounded labelled sample propose conjunctive rules (every path from the root), a logistic model
with a lasso penalty picks and weighs few of them, and the result is one Column expression.

Defined results
---------------
* Null and empty texts have all statistics 0 and are scored like any text.
* Learning uses labels of documents whose crc32(doc_id as text) mod 4 is not 2, at most about
  ``TRAIN_ROWS`` of them by hash (a documented bound of a classifier); repeated labels count once, null labels not at all.
  Without labels every score is 0.5.  With one class only, the score is the smoothed share of that class.
* Repeated rows are scored alike; a null doc_id is not held out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.language_id import held_out
from gridloom.llm.runtime import materialise

TRAIN_ROWS = 20_000
TREES, DEPTH, CUTS = 40, 3, 24
STATISTICS = (
    "n_words", "mean_word", "distinct_share", "top_share", "adjacent_share", "upper_share", "digit_share", "symbol_share",
    "mark_share", "punct_share", "lines_per_word", "dup_line_share", "mean_line", "nonascii_share", "long_word_share", "repeat3_share",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:'\"()-"]] = True
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask)])
    return c[off[1:]] - c[off[:-1]]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows x STATISTICS) of whole texts."""
    rows = len(off) - 1
    s, e, wr = W.spans(data, off, W.SPACED)
    h = W.hashes(data, s, e)
    ls, le, lr = W.spans(data, off, _NOT_NEWLINE)
    lh = W.hashes(data, ls, le)
    n, lines = np.diff(wr), np.diff(lr)
    size = (e - s).astype(float)
    chars = np.add.reduceat(np.append(size, 0), np.minimum(wr[:-1], len(size)))[:rows] * (n > 0) if len(size) else np.zeros(rows)
    distinct, top, rep3, dup = np.zeros(rows), np.zeros(rows), np.zeros(rows), np.zeros(rows)
    tri = np.zeros(0, np.uint64)
    if len(h) >= 3:
        c = W.seeds(3, 21)
        tri = h[:-2] * c[0] + h[1:-1] * c[1] + h[2:] * c[2]
    for k in np.flatnonzero(n):
        _, counts = np.unique(h[wr[k] : wr[k + 1]], return_counts=True)
        distinct[k], top[k] = len(counts), counts.max()
        if n[k] >= 3:
            t = tri[wr[k] : wr[k + 1] - 2]
            rep3[k] = 1 - len(np.unique(t)) / len(t)
        if lines[k] > 1:
            dup[k] = lines[k] - len(np.unique(lh[lr[k] : lr[k + 1]]))
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = h[1:] == h[:-1]
        first = wr[:-1][n > 0]
        same[first] = False
    word = np.maximum(n, 1)
    total = np.maximum(chars, 1)
    share = lambda table: _sums(table[data], off) / total
    out = np.column_stack([
        n, chars / word, distinct / word, top / word, _sums(same, wr) / word,
        _sums((data >= 65) & (data <= 90), off) / total, _sums((data >= 48) & (data <= 57), off) / total,
        share(_SYMBOL), share(_MARK), share(_PUNCT), lines / word, dup / np.maximum(lines, 1), chars / np.maximum(lines, 1),
        _sums(data >= 0x80, off) / total, _sums(size > 20, wr) / word, rep3,
    ]).astype(float)
    out[n == 0] = 0.0
    return out


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and one double column per statistic."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column("text")):
                x = statistics(data, off)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(c) for c in x.T.copy())], names=["doc_id", *STATISTICS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater, cutoff) conditions


@dataclass
class Ensemble:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as a Spark expression over the statistics columns."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            hit = F.lit(True)
            for k, greater, cut in rule:
                c = F.col(STATISTICS[k])
                hit = hit & ((c > cut) if greater else (c <= cut))
            z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * _hits(x, rule)
        return 1 / (1 + np.exp(-z))


def _hits(x: np.ndarray, rule: Rule) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for k, greater, cut in rule:
        hit &= (x[:, k] > cut) if greater else (x[:, k] <= cut)
    return hit


def _grow(bins: np.ndarray, g: np.ndarray, at: np.ndarray, path: tuple, depth: int, rules: set, leaves: list) -> None:
    """Split rows ``at`` where the squared sum of gradients gains most; record each child's path."""
    best = (1e-9, None)
    if depth and len(at) >= 20:
        total, n = g[at].sum(), len(at)
        for k in range(bins.shape[1]):
            b = bins[at, k]
            gs, ns = np.cumsum(np.bincount(b, g[at], CUTS + 1))[:-1], np.cumsum(np.bincount(b, minlength=CUTS + 1))[:-1]
            ok = (ns >= 5) & (n - ns >= 5)
            if ok.any():
                gain = np.where(ok, gs**2 / np.maximum(ns, 1) + (total - gs) ** 2 / np.maximum(n - ns, 1) - total**2 / n, 0)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], (k, j))
    if best[1] is None:
        leaves.append(at)
        return
    k, j = best[1]
    left = bins[at, k] <= j
    for greater, part in ((False, at[left]), (True, at[~left])):
        child = (*path, (k, greater, j))
        rules.add(child)
        _grow(bins, g, part, child, depth - 1, rules, leaves)


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ensemble:
    """Trees propose rules, lasso logistic regression (FISTA, penalty by a held fifth) weighs them."""
    n = len(y)
    if not n:
        return Ensemble()
    prior = np.log((y.sum() + 1) / (n - y.sum() + 1))
    if y.min() == y.max():
        return Ensemble(float(prior))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    z, paths = np.full(n, prior), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g = y - p
        sample = rng.choice(n, max(min(n, 40), n // 2), replace=False)
        leaves: list[np.ndarray] = []
        grown: set = set()
        _grow(bins, g, sample, (), int(rng.integers(1, DEPTH + 1)), grown, leaves)
        paths |= grown
        for r in grown:  # the boosted fit moves on whole data, leaf by leaf
            if not any(len(q) > len(r) and q[: len(r)] == r for q in grown):
                hit = np.ones(n, bool)
                for k, greater, j in r:
                    hit &= (bins[:, k] > j) if greater else (bins[:, k] <= j)
                if hit.any():
                    z[hit] += 0.3 * g[hit].sum() / max(1e-6, (p[hit] * (1 - p[hit])).sum() + 1.0)
    rules: dict[Rule, None] = {}
    for path in sorted(paths):
        # a path may test one statistic twice: keep the tighter bound of each side
        tight: dict[tuple[int, bool], int] = {}
        for k, greater, j in path:
            tight[k, greater] = j if (k, greater) not in tight else (max if greater else min)(tight[k, greater], j)
        rules[tuple((k, greater, float(cuts[k][min(j, len(cuts[k]) - 1)])) for (k, greater), j in sorted(tight.items()))] = None
    listed = list(rules)
    r = np.column_stack([_hits(x, q) for q in listed]).astype(np.float64)
    held = rng.permutation(n) < max(1, n // 5)
    best = (np.inf, None, None)
    w, b = np.zeros(len(listed)), float(prior)
    for penalty in (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005):
        w, b = _lasso(r[~held], y[~held], penalty, w, b)
        p = np.clip(1 / (1 + np.exp(-(r[held] @ w + b))), 1e-9, 1 - 1e-9)
        loss = -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()
        if loss < best[0] - 1e-4:
            best = (loss, w.copy(), b)
    _, w, b = best
    return Ensemble(float(b), [(q, float(v)) for q, v in zip(listed, w) if abs(v) > 1e-6])


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, b: float, steps: int = 150) -> tuple[np.ndarray, float]:
    n = max(1, len(y))
    u = np.ones(r.shape[1])
    for _ in range(8):  # largest eigenvalue by power iteration
        u = r.T @ (r @ u)
        u /= max(np.linalg.norm(u), 1e-12)
    step = 1 / (0.25 * (np.linalg.norm(r @ u) ** 2 / n + 1) * 1.1)
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(r @ v + c))) - y
        nw = v - step * (r.T @ g) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ensemble:
    """Fit on a bounded hash sample of the labelled, not held-out rows of a statistics table."""
    lab = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y")).distinct()
    lab = lab.where(~held_out(2, 4, F.col("_id")))
    n = lab.count()
    u = F.conv(F.substring(F.md5(F.concat(F.lit("quality:"), F.col("_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    found = stats.join(lab.where(u < min(1.0, rows / max(1, n))), F.col("doc_id") == F.col("_id"))
    # one row an id and label, however often the table has it: the sample is bounded by its ids
    found = found.groupBy("_id", "y").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    data = found.select("_id", "y", *(F.col(f"s.{c}").alias(c) for c in STATISTICS)).toPandas()
    data = data.sort_values(list(data.columns)).reset_index(drop=True)
    return fit_rules(data[list(STATISTICS)].to_numpy(float), data["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    stats = materialise(statistics_table(docs), "text-statistics")
    model = fit(stats, labels)
    out = stats.select("doc_id", held_out(2, 4).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
