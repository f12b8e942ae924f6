"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns the corpus into segments, each a few megabytes of whole documents:
a sorted term table, posting offsets and word positions, written to the shared folder.
``phrases`` answers phrase queries per segment: the postings of a window's rarest term give
candidate starts, and the postings of its other terms, from rare to frequent, are
intersected after adjusting for their offsets.  Segments are independent, so no term, however
frequent, gathers in one task.  ``near`` answers proximity queries on the same index.

Defined results
---------------
* Words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``; null or wordless text has none.
* A window is 13 consecutive words of an item, or the whole item if shorter; items without words have none.
  Words compare by 64-bit hash.
* Items with equal ``item_id`` count as one; a null ``item_id`` is named ``null``.  Repeated documents are judged row by row.
* ``items_sha256`` of a document without items is that of the empty string; empty tables give empty (or clean) results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.arrays import Shelf, save
from gridloom.llm.runtime import materialise, released, scratch

WINDOW = 13
#: a document is contaminated when this many times its hit words reach its words
SHARE = 20
#: words of benchmark items compiled into one block of queries; more items make more blocks
BLOCK_WORDS = 200_000
#: candidate places that a search looks at together (one window's candidates are never split)
CANDIDATES = 500_000

_u64 = np.uint64


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    for batch in batches:
        for i, j, data, off in W.chunks(batch.column("text")):
            start, end, rows = W.spans(data, off, W.ALNUM, fold=True)
            h = W.hashes(data, start, end)
            n = np.diff(rows)
            # one unused position between documents: consecutive positions never span two of them
            pos = np.arange(len(h), dtype=np.int64) + np.repeat(np.arange(j - i), n)
            order = np.argsort(h, kind="stable")
            sorted_h = h[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])) if len(h) else np.zeros(0, np.int64)
            blobs = [sorted_h[first], np.append(first, len(h)).astype(np.uint32), pos[order].astype(np.uint32)]
            docs = pa.array([batch.column("doc_id").slice(i, j - i).to_pylist()], pa.list_(batch.schema.field("doc_id").type))
            cols = [pa.array([serial]), docs, pa.array([n.astype(np.int32).tolist()], pa.list_(pa.int32()))]
            cols += [pa.array([b.tobytes()], pa.binary()) for b in blobs]
            yield pa.RecordBatch.from_arrays(cols, names=["segment", "doc_ids", "counts", "terms", "offsets", "positions"])
            serial += 1


def build_index(docs: DataFrame) -> DataFrame:
    """Positional index of ``docs(doc_id, text)``, one row per segment, stored in the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"segment long, doc_ids array<{kind}>, counts array<int>, terms binary, offsets binary, positions binary"
    return materialise(docs.select("doc_id", "text").mapInArrow(released(_segments), schema), "positional-index")


class _Segment:
    """Read view of one index row."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], _u64)
        self.offsets = np.frombuffer(row["offsets"], np.uint32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32).astype(np.int64)
        n = np.asarray(row["counts"], np.int64)
        self.base = np.concatenate([[0], np.cumsum(n + 1)])  # first position of each document

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Index of each term, -1 where absent."""
        if not len(self.terms):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def keys(self) -> np.ndarray:
        """(term, position) of all postings as one ascending array."""
        return (np.repeat(np.arange(len(self.terms)), np.diff(self.offsets)) << 32) | self.positions

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of each given term, with the index of the query they belong to."""
        lo, size = self.offsets[term], self.offsets[term + 1] - self.offsets[term]
        who = np.repeat(np.arange(len(term)), size)
        at = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        return who, self.positions[at]


def compile_windows(texts: list[str], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of the texts: (windows x width hashes, 0 beyond a short one's end; lengths;
    and the (window, text) pairs saying which text holds which window)."""
    win, length, owner = [], [], []
    for i, _, data, off in W.chunks(pa.array(texts, pa.string())):
        start, end, rows = W.spans(data, off, W.ALNUM, fold=True)
        h = W.hashes(data, start, end)
        for k in range(len(rows) - 1):
            item = h[rows[k] : rows[k + 1]]
            if not len(item):
                continue
            block = np.lib.stride_tricks.sliding_window_view(item, width) if len(item) >= width else np.pad(item, (0, width - len(item)))[None, :]
            win.append(block)
            length += [min(width, len(item))] * len(block)
            owner += [i + k] * len(block)
    if not win:
        z = np.zeros(0, np.int64)
        return np.zeros((0, width), _u64), z, z, z
    every, back = np.unique(np.column_stack([np.concatenate(win), np.asarray(length, _u64)]), axis=0, return_inverse=True)
    pair = np.unique(np.column_stack([back.ravel(), np.asarray(owner)]), axis=0)
    return every[:, :width].copy(), every[:, width].astype(np.int64), pair[:, 0], pair[:, 1]


def find(seg: _Segment, win: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences (window, start position) of the windows in a segment."""
    unique, inverse = np.unique(win, return_inverse=True)
    term = seg.lookup(unique)[inverse.reshape(win.shape)]
    used = np.arange(win.shape[1])[None, :] < length[:, None]
    alive = np.flatnonzero(((term >= 0) | ~used).all(axis=1))
    if not len(alive):
        return alive, alive
    term, used = term[alive], used[alive]
    df = np.where(used, seg.offsets[np.maximum(term, 0) + 1] - seg.offsets[np.maximum(term, 0)], np.iinfo(np.int64).max)
    order = np.argsort(df, axis=1, kind="stable")
    load = np.cumsum(df[np.arange(len(alive)), order[:, 0]])
    cuts = np.searchsorted(load, np.arange(0, load[-1] + CANDIDATES, CANDIDATES), "right")
    cuts = np.unique(np.concatenate([[0], cuts, [len(alive)]]))
    keys, found = seg.keys(), []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        who, at = _intersect(seg, keys, term[lo:hi], used[lo:hi], order[lo:hi])
        found.append((alive[lo + who], at))
    return tuple(np.concatenate(x) for x in zip(*found))


def _intersect(seg: _Segment, keys: np.ndarray, term: np.ndarray, used: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) where all terms of a window stand in their places, tried from the rarest term on."""
    who, at = seg.expand(term[np.arange(len(term)), order[:, 0]])
    at = at - order[who, 0]
    who, at = who[at >= 0], at[at >= 0]
    for r in range(1, term.shape[1]):
        if not len(who):
            break
        slot = order[who, r]
        test = np.flatnonzero(used[who, slot])  # short windows are done
        if not len(test):
            continue
        want = (term[who[test], slot[test]] << 32) | (at[test] + slot[test])
        hit = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
        stay = np.ones(len(who), bool)
        stay[test] = hit
        who, at = who[stay], at[stay]
    return who, at


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Segment]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in ("segment", "counts", "terms", "offsets", "positions")}
            yield row["segment"], _Segment(row)


def store_windows(spark: SparkSession, texts: list[str], names: list[str], width: int = WINDOW) -> str:
    """The windows of named texts as a file in the shared folder; returns its name."""
    win, length, pw, pt = compile_windows(texts, width)
    raw = [n.encode() for n in names]
    uri = scratch(spark, "windows") + "/windows.bin"
    cut = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
    save(uri, {"windows": win.ravel(), "length": length, "bounds": np.searchsorted(pw, np.arange(len(win) + 1)), "owner": pt, "names": np.frombuffer(b"".join(raw), np.uint8), "cut": cut, "width": np.array([width])})
    return uri


def phrases(index: DataFrame, blocks: list[str]) -> DataFrame:
    """Exact phrase matches of stored windows, in one pass over the index: for each document and block with any,
    (segment, row, starts, ends, items): merged ranges of hit words, and the names of the texts with occurring windows."""

    def match(batches):
        shelf = Shelf()
        for segment, seg in _segment_rows(batches):
            for block in blocks:
                q = shelf.get(block)
                length, bounds, owner, cut = q["length"], q["bounds"], q["owner"], q["cut"]
                who, at = find(seg, q["windows"].reshape(len(length), int(q["width"][0])), length)
                if not len(who):
                    continue
                row = np.searchsorted(seg.base, at, "right") - 1
                order = np.lexsort((at, row))
                who, at, row = who[order], at[order], row[order]
                out = {"segment": [], "row": [], "starts": [], "ends": [], "items": []}
                for r in np.unique(row):
                    lo, hi = np.searchsorted(row, [r, r + 1])
                    s = at[lo:hi] - seg.base[r]
                    reach = np.maximum.accumulate(s + length[who[lo:hi]])
                    new = np.concatenate([[True], s[1:] > reach[:-1]])
                    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
                    items = np.unique(np.concatenate([owner[bounds[w] : bounds[w + 1]] for w in np.unique(who[lo:hi])]))
                    out["segment"].append(segment)
                    out["row"].append(int(r))
                    out["starts"].append(s[new].tolist())
                    out["ends"].append(reach[last].tolist())
                    out["items"].append(sorted({q["names"][cut[k] : cut[k + 1]].tobytes().decode() for k in items}))
                yield pa.RecordBatch.from_pydict(
                    out, schema=pa.schema([("segment", pa.int64()), ("row", pa.int32()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
                )

    return index.select("segment", "counts", "terms", "offsets", "positions").mapInArrow(
        released(match), "segment long, row int, starts array<long>, ends array<long>, items array<string>"
    )


def near(index: DataFrame, query: str, distance: int) -> DataFrame:
    """Proximity matches: (doc_id, position) of each occurrence of the query's rarest word in a segment that has every
    other word of the query within ``distance`` words, in the same document."""
    data, off = W.flat(pa.array([query]))
    start, end, _ = W.spans(data, off, W.ALNUM, fold=True)
    want = np.unique(W.hashes(data, start, end))
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    out_type = pa.schema([("segment", pa.int64()), ("row", pa.int32()), ("position", pa.int64())])

    def match(batches):
        for segment, seg in _segment_rows(batches):
            term = seg.lookup(want)
            if not len(term) or (term < 0).any():
                continue
            term = term[np.argsort(seg.offsets[term + 1] - seg.offsets[term], kind="stable")]
            _, at = seg.expand(term[:1])
            row = np.searchsorted(seg.base, at, "right") - 1
            lo, hi = np.maximum(at - distance, seg.base[row]), np.minimum(at + distance, seg.base[row + 1] - 1)
            keep = np.ones(len(at), bool)
            for t in term[1:]:
                post = seg.positions[seg.offsets[t] : seg.offsets[t + 1]]
                keep &= np.searchsorted(post, lo, "left") < np.searchsorted(post, hi, "right")
            if keep.any():
                cols = [np.full(keep.sum(), segment), row[keep].astype(np.int32), (at - seg.base[row])[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=out_type)

    hits = index.select("segment", "counts", "terms", "offsets", "positions").mapInArrow(match, "segment long, row int, position long")
    docs = index.select("segment", F.posexplode("doc_ids").alias("row", "doc_id"))
    return hits.join(docs, ["segment", "row"]).select(F.col("doc_id").cast(kind).alias("doc_id"), "position")


def item_blocks(items: DataFrame) -> Iterator[tuple[list[str], list[str]]]:
    """(texts, names) of the distinct benchmark items in blocks of about ``BLOCK_WORDS`` words."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("k"), "text").where("text is not null").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // (BLOCK_WORDS * 6)))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("k", "text"), F.lit(blocks)) == b).collect()
        yield [r["text"] for r in part], [r["k"] for r in part]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    index = build_index(docs)
    found = phrases(index, [store_windows(docs.sparkSession, *block) for block in item_blocks(items)])
    merged = found.groupBy("segment", "row").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    covered = F.aggregate(
        "ranges",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0), r["ends"] - F.greatest(r["starts"], a["end"]))).cast("long").alias("n"),
            F.greatest(a["end"], r["ends"]).cast("long").alias("end"),
        ),
        lambda a: a["n"],
    )
    merged = merged.select("segment", "row", covered.alias("n_hit"), "items")
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "counts")).alias("row", "d"))
    out = rows.select("segment", "row", "d.doc_ids", F.col("d.counts").cast("long").alias("n_words")).join(merged, ["segment", "row"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc_ids").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; columns unchanged.  Rows are told apart by
    (doc_id, text), so repeated ids with different texts are judged by their own text."""
    tag = "__gl_hash"
    keyed = docs.withColumn(tag, F.xxhash64("text"))
    verdicts = contamination(keyed.select(F.struct("doc_id", tag).alias("doc_id"), "text"), items)
    bad = verdicts.where("contaminated").select(F.col("doc_id.doc_id").alias("__gl_id"), F.col(f"doc_id.{tag}").alias("__gl_h")).distinct()
    bad = materialise(bad, "contaminated")  # all that the result needs of the index
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("__gl_id")) & (F.col(tag) == F.col("__gl_h")), "left_anti").drop(tag)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i+12], ' '))) AS t FROM b WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT k, lens.n, unnest(list_transform(range(1, len(w) - lens.n + 2), lambda i: {'p': i, 't': array_to_string(w[i:i+lens.n-1], ' ')}), recursive := true) FROM d, lens WHERE len(w) >= lens.n
), hit AS (SELECT DISTINCT dw.k, dw.p, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
words AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT k, p, n FROM hit)) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(its.h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN its USING (k)
"""
