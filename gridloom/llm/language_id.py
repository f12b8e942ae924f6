"""Language identification: averaged hashed subword embeddings with a linear softmax, trained
by stochastic gradient descent in numpy, with temperature-calibrated probabilities and rejection.

The features of a text are its byte 2- and 3-grams (A-Z folded), hashed into ``BUCKETS``
embeddings and averaged over the whole text.  After training the embedding and the softmax
multiply out to one score vector per bucket, so prediction is a gather and a sum.

Defined results
---------------
* Learning uses rows with a text, a language and a doc_id whose crc32 mod 4 is not 2: a hash
  sample of about ``TRAIN_DOCS`` ids and ``TRAIN_BYTES``, spread evenly over the ``TRAIN_LANGS`` most frequent languages,
  of texts of up to ``TEXT_BYTES``, the least text of each id (documented bounds of a classifier).
* Null texts and texts without a letter are ``und`` with score 0 and not accepted; so is everything
  if there is nothing to learn from.  A null doc_id is not held out and not learned from.
* ``accepted`` is false where the calibrated probability stays below the rejection threshold, fitted on
  a fifth of the sample; ``lang_pred`` is the most probable language all the same.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.runtime import released

BUCKETS = 1 << 16
DIM = 16
EPOCHS = 4
#: share of a document's error that one step takes back, at first
RATE = 0.5
TRAIN_DOCS = 4_000
#: bytes of the sample, of a text that may be in it, and languages that are learned, the most frequent ones
TRAIN_BYTES, TEXT_BYTES, TRAIN_LANGS = 64 << 20, 1 << 20, 1_000
TARGET_ACCURACY = 0.99
TEMPERATURES = np.geomspace(1e-3, 1e3, 121)

_u64 = np.uint64


def held_out(part: int, parts: int, key: Column | None = None) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``, is ``part``; false for a null id."""
    key = F.col("doc_id") if key is None else key
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))


def grams(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: bucket of each gram, and the range of each text's grams."""
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    x = low.astype(np.uint32)
    out = []
    for size in (2, 3):
        if len(x) < size:
            out.append((np.zeros(0, np.int64), np.zeros(len(off), np.int64)))
            continue
        g = x[: len(x) - size + 1].copy()
        for k in range(1, size):
            g = (g << np.uint32(8)) | x[k : len(x) - size + 1 + k]
        b = ((g * np.uint32(0x9E3779B1 + 2 * size)) >> np.uint32(16)).astype(np.int64)
        inside = np.ones(len(b), bool)
        for k in range(1, size):
            cut = off[1:-1] - k
            inside[cut[(cut >= 0) & (cut < len(b))]] = False
        n = np.maximum(np.diff(off) - size + 1, 0)
        out.append((b[inside], np.concatenate([[0], np.cumsum(n)])))
    return out


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows = len(off) - 1
        total, n = np.zeros((rows, len(self.langs))), np.zeros(rows)
        for b, at in grams(data, off):
            size = np.diff(at)
            live = np.flatnonzero(size)
            if len(live):
                total[live] += np.add.reduceat(self.scores[b], at[:-1][live], axis=0)
            n += size
        return total / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, off) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """Fit embeddings and softmax; a fifth of the texts calibrates temperature and rejection."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.searchsorted(names, langs)
    docs = []
    for t in texts:
        d, o = W.flat(pa.array([t]))
        b = np.concatenate([g for g, _ in grams(d, o)])
        u, c = np.unique(b, return_counts=True)
        docs.append((u, (c / max(1, len(b))).astype(np.float32)))
    order = rng.permutation(len(docs))
    held = order[: len(order) // 5] if len(order) >= 50 else order[:0]
    learn = order[len(held) :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    rate, best = RATE, np.inf
    for epoch in range(EPOCHS):
        before = emb.copy(), soft.copy(), bias.copy()
        total = 0.0
        for done, k in enumerate(rng.permutation(learn)):
            u, f = docs[k]
            x = f @ emb[u] if len(u) else np.zeros(DIM, np.float32)
            z = x @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            total -= np.log(max(float(p[y[k]]), 1e-12))
            p[y[k]] -= 1
            # the mean's gradient is spread over few, rarely seen buckets: scaled up by their number
            wide = min(len(u), 50)
            # divided by how far a step of this size moves the logits, so that no step overshoots
            step = rate * (1 - (epoch + done / len(learn)) / EPOCHS) / (0.1 + x @ x + wide * (f @ f) * (soft * soft).sum())
            back = soft @ p
            soft -= step * np.outer(x, p)
            bias -= 0.1 * step * p
            emb[u] -= step * wide * f[:, None] * back[None, :]
        if not (np.isfinite(total) and np.isfinite(emb).all() and np.isfinite(soft).all()) or total > 1.5 * best + len(learn) * 0.01:
            (emb, soft, bias), rate = before, rate / 4  # a pass that made things worse is undone
        best = min(best, total) if np.isfinite(total) else best
    model = Model(names, (emb @ soft).astype(np.float32), bias.astype(np.float64))
    if len(held):
        # each held text whole and as a short piece of itself: confidence has to hold for little evidence too
        at = [(rng.integers(0, max(1, len(texts[k]))), rng.integers(2, 40)) for k in held]
        d, o = W.flat(pa.array([texts[k] for k in held] + [texts[k][i : i + n] for k, (i, n) in zip(held, at)]))
        some = has_letter(d, o)
        z, t = model.logits(d, o)[some], np.tile(y[held], 2)[some]
        if not len(t):
            return model
        # smoothed targets: even where all are right, boundless certainty is not the best fit
        soft_target = np.full((len(t), len(names)), 1 / (len(t) + 2) / max(1, len(names) - 1))
        soft_target[np.arange(len(t)), t] = 1 - 1 / (len(t) + 2)
        loss = [-(soft_target * np.log(np.maximum(softmax(z / g), 1e-300))).sum(axis=1).mean() for g in TEMPERATURES]
        model.temperature = float(TEMPERATURES[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == t
        rank = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[rank]) / np.arange(1, len(t) + 1) >= TARGET_ACCURACY)
        model.reject_below = float(top[rank][good[-1]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, total: int = TRAIN_DOCS) -> Model | None:
    """Train on a hash sample of ``docs(doc_id, text, lang)``, even over the languages, of about ``total`` ids and
    ``TRAIN_BYTES``, one text an id."""
    usable = docs.where(~held_out(2, 4) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("doc_id", "text", "lang", F.octet_length("text").alias("_size")).where(F.col("_size") <= TEXT_BYTES)
    count = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("size")).orderBy(F.desc("n"), "lang").limit(TRAIN_LANGS).collect()
    if not count:
        return train([], [])
    share = {r["lang"]: min(1.0, total / len(count) / r["n"], TRAIN_BYTES / len(count) / max(1, r["size"])) for r in count}
    known = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("lang:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = usable.where(u < F.coalesce(F.try_element_at(known, F.col("lang")), F.lit(0.0))).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["text"], r["lang"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    ascii_ = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    seen = np.concatenate([[0], np.cumsum(ascii_)])
    out = seen[off[1:]] > seen[off[:-1]]
    for k in np.flatnonzero(~out & (np.diff(off) > 0)):
        part = data[off[k] : off[k + 1]]
        if (part >= 0x80).any():
            out[k] = any(c.isalpha() for c in part.tobytes().decode())
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column("text"), 2 << 20):
                lang, score = np.full(j - i, "und", object), np.zeros(j - i)
                known = has_letter(data, off)
                if model is not None and known.any():
                    p = model.probabilities(data, off)
                    lang[known] = np.asarray(model.langs, object)[p.argmax(axis=1)][known]
                    score[known] = p.max(axis=1)[known]
                ok = known & (score >= model.reject_below) if model is not None else known & False
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(lang, pa.string()), pa.array(score), pa.array(ok)],
                    names=["doc_id", "lang_pred", "score", "accepted"],
                )

    out = docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score", "accepted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
