"""Near-duplicate documents: many universal-hash minima, banding, signature verification, exact
confirmation, and connected components by alternating large-star and small-star.

Defined results
---------------
* A document's set is its distinct 5-word shingles (A-Z lower-cased); a text of one to
  four words has one shingle, the whole sequence; null, empty or wordless text has none
  and is linked with nothing.
* Links need ``100 * |A & B| >= 85 * |A | B|`` on the full sets; shingles are compared by
  64-bit hash.
* Rows that repeat a ``doc_id`` are one document, linked by any of their texts: edges tie all its sets together.  A null ``doc_id`` is linked with
  nothing: its ``component_id`` is null and it is kept.  Extra input columns are ignored.

Shape of the job
----------------
Equal sets are collapsed first by a 128-bit set fingerprint (a partially aggregated
``groupBy``), so exact copies, however many, become one node.  Only nodes that share a band
bucket with another node get their sets materialised.  A node whose *private* shingles
(found in no other candidate) exceed 15 % of its set cannot reach the threshold with any
partner and leaves at once; the same counts give an upper bound on the similarity of any
pair, tested before a pair is ever emitted.  Of the pairs left, those whose signatures of 64 minima
agree in too few places go, before full sets are brought together.  In each bucket every node is confirmed against
the bucket's best centre; only nodes still outside that centre's component are compared with
nodes of other components, through the rare front of their sets (prefix and positional
filters, both exact), so a group of copies costs links linear in its size, and no link that
would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.runtime import materialise, released, remove

SHINGLE = 5
BANDS, ROWS = 16, 4
THRESHOLD = 85  # percent

_u64 = np.uint64
_MUL = W.seeds(BANDS * ROWS, 11) | _u64(1)
_ADD = W.seeds(BANDS * ROWS, 12)
_POS = W.seeds(SHINGLE, 13)
_ROW = W.seeds(ROWS, 14)
_BAND = W.seeds(BANDS, 15)
#: minima that must agree, of 64, before full sets are compared: two sets at the threshold fall short with probability
#: below 1e-11.  Each minimum leaves 14 bits in its document's signature, four to a 60-bit number per band.
AGREE = 32
_LANES = sum(0x3FFF << 15 * r for r in range(ROWS))
_CARRY = sum(1 << 15 * r + 14 for r in range(ROWS))


def shingles(h: np.ndarray, rows: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, in order with repeats, and the range of each row's shingles."""
    count = np.diff(rows)
    full = np.maximum(count - k + 1, 0)
    short = (count > 0) & (count < k)
    out_rows = np.zeros(len(rows), np.int64)
    np.cumsum(full + short, out=out_rows[1:])
    out = np.empty(out_rows[-1], _u64)
    if len(h) >= k:
        roll = np.zeros(len(h) - k + 1, _u64)
        for j in range(k):
            roll += h[j : len(h) - k + 1 + j] * _POS[j]
        roll = W.mix(roll)
        at = np.ones(len(roll), bool)  # a window must not cross into the next row
        for j in range(1, k):
            cut = rows[1:-1] - j
            at[cut[(cut >= 0) & (cut < len(roll))]] = False
        picked = np.flatnonzero(at)
        # windows of rows shorter than k never survive: each of their starts is cut
        target = np.ones(len(out), bool)
        target[out_rows[:-1][short]] = False
        out[np.flatnonzero(target)] = roll[picked]
    for i in np.flatnonzero(short):
        part = h[rows[i] : rows[i + 1]]
        out[out_rows[i]] = W.mix((part * _POS[: len(part)]).sum(dtype=_u64) + _u64(len(part)))
    return out, out_rows


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _row_shingles(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, off in W.chunks(texts):
        start, end, rows = W.spans(data, off, W.SPACED)
        sh, sr = shingles(W.hashes(data, start, end), rows)
        yield i, j, sh, sr


def _bands(sh: np.ndarray, sr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each band, and the band's part of the signature, for each non-empty row, as (rows, BANDS)."""
    live = np.flatnonzero(np.diff(sr))
    at = sr[:-1][live]
    out, sig = np.zeros((len(live), BANDS), _u64), np.zeros((len(live), BANDS), _u64)
    block = 1 << 16
    x = np.empty(len(sh), _u64)
    for b in range(BANDS if len(at) else 0):
        acc = np.zeros(len(live), _u64) + _BAND[b]
        for r in range(ROWS):
            for s in range(0, len(sh), block):
                np.multiply(sh[s : s + block], _MUL[b * ROWS + r], out=x[s : s + block])
                x[s : s + block] += _ADD[b * ROWS + r]
            least = np.minimum.reduceat(x, at)
            acc += least * _ROW[r]
            sig[:, b] |= (W.mix(least) & _u64(0x3FFF)) << _u64(15 * r)
        out[:, b] = W.mix(acc)
    return out, sig


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "fp1", "fp2", *(f"b{k}" for k in range(BANDS)), *(f"g{k}" for k in range(BANDS))]
    for batch in batches:
        for i, j, sh, sr in _row_shingles(batch.column("text")):
            n = np.zeros(j - i, np.int64)
            fp = np.zeros((j - i, 2), _u64)
            for k in np.flatnonzero(np.diff(sr)):
                distinct = np.unique(sh[sr[k] : sr[k + 1]])
                n[k] = len(distinct)
                fp[k] = distinct.sum(dtype=_u64), W.mix(distinct).sum(dtype=_u64)
            bands = np.zeros((2, j - i, BANDS), _u64)
            bands[:, np.diff(sr) > 0] = _bands(sh, sr)
            cols = [batch.column("doc_id").slice(i, j - i), pa.array(n), _signed(fp[:, 0].copy()), _signed(fp[:, 1].copy())]
            cols += [_signed(part[:, k].copy()) for part in bands for k in range(BANDS)]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, sh, sr in _row_shingles(batch.column("text")):
            parts = [np.unique(sh[sr[k] : sr[k + 1]]).view(np.int64) for k in range(j - i)]
            off = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) for p in parts], out=off[1:])
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts)))
            fp1 = pa.array([int(p.sum()) for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), fp1, lists], names=["node", "fp1", "shingles"])


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Upper bound on similarity from set sizes and private shingles reaches the threshold."""
    shared = F.least(n1 - p1, n2 - p2)
    return 100 * shared >= THRESHOLD * (n1 + n2 - shared)


def _agreement(prefix: str, other: str) -> Column:
    """Number of minima that two signatures have in common."""
    total = F.lit(0)
    for k in range(BANDS):
        # a lane that differs carries into its top bit
        differ = (F.col(f"{prefix}{k}").bitwiseXOR(F.col(f"{other}{k}")) + F.lit(_LANES)).bitwiseAND(F.lit(_CARRY))
        total = total + ROWS - F.bit_count(differ)
    return total


def _confirm(pairs: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of the distinct pairs (u, fu, v, fv) of sets, each a node and its ``fp1``, whose signatures agree and
    whose full sets reach the threshold; stored, some of them repeated."""
    a = signatures.select(F.col("node").alias("u"), F.col("fp1").alias("fu"), *(F.col(f"g{k}").alias(f"x{k}") for k in range(BANDS)))
    b = signatures.select(F.col("node").alias("v"), F.col("fp1").alias("fv"), *(F.col(f"g{k}").alias(f"y{k}") for k in range(BANDS)))
    # by u and by v in turn: each join has an exchange of its own below it, so that a hub's can be split
    agreed = pairs.join(a, ["u", "fu"]).join(b, ["v", "fv"]).where(_agreement("x", "y") >= AGREE).select("u", "fu", "v", "fv")
    a = sets.select(F.col("node").alias("u"), F.col("fp1").alias("fu"), F.col("shingles").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("fp1").alias("fv"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    found = agreed.join(a, ["u", "fu"]).join(b, ["v", "fv"]).where(100 * both >= THRESHOLD * (F.size("su") + F.size("sv") - both))
    return materialise(found.select("u", "v"), "links")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, fu, v, fv) of sets of different components, one of them astray, that can still reach the threshold.

    Shingles are ordered by frequency, rare first.  At the first shingle two sets share, at places i and j,
    they have at most ``min(n1 - i, n2 - j)`` in common; a pair that links has 85 of 185 parts of ``n1 + n2``.
    So only the front of each set is compared, and a pair is emitted only where its bound still holds."""
    key = ["node", "fp1", "n", "component", "astray"]
    rows = sets.join(nodes, ["node", "fp1"]).select(*key, F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    ordered = rows.join(often, "s").groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("k", "s"))).alias("all"))
    front = F.size("all") - F.ceil(F.size("all") * THRESHOLD / 100.0).cast("int") + 1
    front = ordered.select(*key, F.posexplode(F.slice("all", F.lit(1), front)).alias("at", "x")).where("x.k > 1")
    front = materialise(front.select(*key, "at", "x.s"), "fronts")
    end = F.struct("node", "fp1")
    left = front.where("astray").select("s", end.alias("a"), F.col("n").alias("n1"), F.col("at").alias("i"), F.col("component").alias("c1"))
    right = front.select("s", end.alias("b"), F.col("n").alias("n2"), F.col("at").alias("j"), F.col("component").alias("c2"))
    reach = F.least(F.col("n1") - F.col("i"), F.col("n2") - F.col("j"))
    found = left.join(right, (left["s"] == right["s"]) & (F.col("c1") != F.col("c2")) & ((100 + THRESHOLD) * reach >= THRESHOLD * (F.col("n1") + F.col("n2"))))
    found = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return found.select(F.col("a.node").alias("u"), F.col("a.fp1").alias("fu"), F.col("b.node").alias("v"), F.col("b.fp1").alias("fv"))


def _ties(linked: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame | None:
    """Edges (u, v) from each ``doc_id`` that has several sets to the node of each of them, stored; None if no id has."""
    ends = linked.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).where("lo <> hi")
    # plain sides, so that the join of an id with many rows can be split
    several = materialise(ends.select("doc_id"), "several")
    if several.isEmpty():
        remove(several)
        return None
    held = materialise(linked.select("doc_id", *key).join(several, "doc_id"), "sets-of-several").distinct()
    ties = materialise(held.join(nodes.select(*key, "node"), key).select(F.col("doc_id").alias("u"), F.col("node").alias("v")), "ties")
    for table in (several, held):
        remove(table)
    return ties


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of an edge table (u, v) of any direction, repeats and loops; component is the
    smallest node reachable.  Alternates large-star and small-star until the edges form stars; each step is written to
    the shared folder.  ``edges`` is read more than once.

    The edges are stars once each node has only greater neighbours, or only one: then nothing is left to do, and the
    table of lowest neighbours is the result.  No step makes more edges than it has got."""
    state = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    stored: list[DataFrame] = []
    while True:
        both = state.union(state.select("v", "u"))
        # stored before it is joined: a join of two plain exchanges can be split where a node has most edges
        low = materialise(both.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "lowest")
        if low.where("lo < u and lo < hi").isEmpty():
            break
        stored.append(low)
        low = low.select("u", F.least("lo", "u").alias("m"))
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("hi")), "lowest")
        after = large
        if not low.where("m < hi").isEmpty():  # else small-star changes nothing
            small = large.join(low.drop("hi"), "u").select("u", "v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            after = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
            stored.append(large)
        for old in (*stored, low):
            remove(old)
        state, stored = after, [after]
    for old in stored:
        remove(old)
    return low.select(F.col("u").alias("node"), F.least("lo", "u").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text, ...)``."""
    src = docs.select("doc_id", "text")
    spent: list[DataFrame] = []

    def store(df: DataFrame, name: str) -> DataFrame:
        spent.append(materialise(df, name))
        return spent[-1]

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, fp1 long, fp2 long, " + ", ".join(f"{c}{k} long" for c in "bg" for k in range(BANDS))
    base = materialise(src.mapInArrow(released(_signatures), schema), "signatures")
    linked = base.where("n_shingles > 0 and doc_id is not null")
    key = ["fp1", "fp2", "n_shingles"]
    nodes = store(
        linked.groupBy(*key).agg(F.min("doc_id").alias("node"), *(F.first(f"{c}{k}").alias(f"{c}{k}") for c in "bg" for k in range(BANDS))), "nodes"
    )
    member = nodes.select("node", "fp1", F.col("n_shingles").alias("n"), F.explode(F.array(*(F.col(f"b{k}") for k in range(BANDS)))).alias("bucket"))
    # tables keyed by bucket are stored before they are joined: a join of two plain exchanges can be split where a bucket is hot
    shared = store(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket"), "shared")
    member = store(member.join(shared, "bucket"), "members")

    # always by a shuffle of both sides: the number of candidates has no bound
    chosen = member.select("node").distinct().hint("merge")
    sets = store(
        src.join(chosen, F.col("doc_id") == F.col("node"), "left_semi").mapInArrow(released(_sets), f"node {kind}, fp1 long, shingles array<long>"), "sets"
    )
    private = (
        sets.select("node", "fp1", F.explode("shingles").alias("s"))
        .groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node"), F.min("fp1").alias("fp1"))
        .where("k = 1").select("node", "fp1", F.lit(1).alias("p"))
        .union(sets.select("node", "fp1", F.lit(0))).groupBy("node", "fp1").agg(F.sum("p").alias("p"))
    )
    # with their signatures
    hopeful = (
        nodes.select("node", "fp1", F.col("n_shingles").alias("n"), *(f"g{k}" for k in range(BANDS))).join(private, ["node", "fp1"])
        .where(100 * (F.col("n") - F.col("p")) >= THRESHOLD * F.col("n"))
    )
    hopeful = store(hopeful, "hopeful")
    member = store(member.drop("n").join(hopeful.select("node", "fp1", "n", "p"), ["node", "fp1"]), "members")
    centre = member.groupBy("bucket").agg(F.min(F.struct("p", "n", "node", "fp1")).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1")
    centre = store(centre.select("bucket", F.col("c.node").alias("cu"), F.col("c.fp1").alias("cf"), F.col("c.n").alias("cn"), F.col("c.p").alias("cp")), "centres")
    star = (
        member.join(centre, "bucket").where(F.col("node") != F.col("cu"))
        .where(_may_link(F.col("n"), F.col("p"), F.col("cn"), F.col("cp")))
        .select(F.col("node").alias("u"), F.col("fp1").alias("fu"), F.col("cu").alias("v"), F.col("cf").alias("fv")).distinct()
    )
    links = _confirm(star, hopeful, sets)
    spent.append(links)
    if (ties := _ties(linked, nodes, key)) is not None:
        spent.append(ties)
        links = links.unionByName(ties)
    comp = components(links)
    spent.append(comp)

    placed = member.join(comp, "node", "left").select("bucket", "node", "fp1", "n", F.coalesce("component", "node").alias("component"))
    home = centre.join(comp, F.col("cu") == F.col("node"), "left").select("bucket", F.coalesce("component", "cu").alias("home"))
    # astray: what a centre did not gather, against everything in its bucket that lies in another component
    placed = store(placed.join(home, "bucket").withColumn("astray", F.col("component") != F.col("home")).drop("home"), "placed")
    astray = placed.where("astray")
    if not astray.isEmpty():
        mixed = placed.join(store(astray.select("bucket").distinct(), "mixed-buckets"), "bucket")
        mixed = store(mixed.groupBy("node", "fp1", "n", "component").agg(F.max("astray").alias("astray")), "mixed")
        spent.append(_confirm(_prefix_pairs(mixed, sets), hopeful, sets))
        if not spent[-1].isEmpty():  # the components so far are stars: only they and the new links are joined up
            comp = components(spent[-1].unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v"))))
            spent.append(comp)

    named = nodes.select(*key, "node").join(comp, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    named = materialise(named, "components")  # a plain side, so that the join of many exact copies can be split
    for table in spent:
        remove(table)
    out = linked.select("doc_id", *key).join(named, key).select("doc_id", "n_shingles", "component_id")
    lone = base.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.unionByName(lone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; columns unchanged."""
    gone = materialise(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gl_gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gl_gone"), "left_anti")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) END AS s FROM w
), g AS (
  SELECT list_sort(s) AS s, min(doc_id) AS node, row_number() OVER () AS k FROM s WHERE len(s) > 0 GROUP BY list_sort(s)
), x AS (SELECT node, len(s) AS n, unnest(s) AS t FROM g),
pairs AS (
  SELECT a.node AS u, b.node AS v FROM x a JOIN x b ON a.t = b.t AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach AS (
  SELECT node, node AS r FROM g UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.node
), c AS (SELECT node, min(r) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id, coalesce(c.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN g ON g.s = list_sort(s.s) LEFT JOIN c ON c.node = g.node
"""
