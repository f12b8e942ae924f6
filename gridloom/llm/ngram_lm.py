"""Language-model scoring with an Elias-Fano n-gram trie (order 3).

Training reads the text twice.  The first pass counts words; a word's id is its rank in hash order.  The second counts
triples by their middle word.  A shard of words whose middle words are frequent is dealt, by third and first word, to
parts of about ``TASK_TOKENS`` tokens; a part merges and stores its triples, and the shard sums their pairs and
gives each successor of a word its rank within that context.  Then every part passes its triples on, with the
rank in place of the third word, to the range of pairs that holds their first two words; a range is again about
``TASK_TOKENS`` tokens.  So no task's work grows with how often a word or pair occurs; a shard's pairs and a pair's
successors are bounded by the vocabulary.  The shards of words and pairs, and the ranges of triples, are files in the
shared folder, memory-mapped by the workers that score: monotone child pointers and child ids as Elias-Fano sequences, 8-bit quantised discounted
probabilities, 16-bit backoff weights.  A query goes down by successor search, the third word as its rank among the
successors of the second.

    p(w) = (c + 1/2) / (N + (V + 1) / 2)
    p(w | h) = q(h w) + backoff(h) * p(w | shorter h),   backoff(h) = 1 - sum of q(h .)

with q the quantised (c - D) / c(h), so every conditional distribution sums to one.  D is n1 / (n1 + 2 n2) of the
whole level, so scores do not depend on the number of shards, parts or ranges.

Defined results
---------------
* Null and empty texts are the end token alone.  Without training documents every word is unknown and
  N = V = 0, so each token has probability 1.  A null doc_id is not held out and is learned from.
* Words compare by 64-bit hash.  Repeated rows are counted and scored one by one; extra columns are ignored.
* Counts are 64-bit; ids take as many bits as the vocabulary needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import elias_fano as EF
from gridloom.llm import words as W
from gridloom.llm.arrays import HELD_BYTES, load, save
from gridloom.llm.language_id import held_out
from gridloom.llm.runtime import discard, released, scratch

#: least count of the pairs and triples that ``train`` keeps unless told otherwise: all of them
MIN_COUNT = 1
#: tokens a task gathers before it passes their counts on, and text scored at once
GATHER = 1_000_000
SCORE_BYTES = 2 << 20
#: tokens whose counts one task merges, and the bytes of text they are taken to have
TASK_TOKENS = 4_000_000
TOKEN_BYTES = 6
#: 8-bit codes are logarithms of probabilities from 1 down to 10 ** -DECADES
DECADES = 8.0

_u64 = np.uint64
END = W.seeds(1, 99)


def _squeeze(a: np.ndarray, rising: bool = False) -> bytes:
    """An array of non-negative numbers as compressed planes of bytes, as differences where it is ascending."""
    a = np.asarray(a).astype(_u64)
    if rising and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(raw: bytes, rising: bool = False) -> np.ndarray:
    """The array again, in 32 bits where its numbers fit."""
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    a = np.zeros((planes.shape[1], 4 if width <= 4 and not rising else 8), np.uint8)
    a[:, :width] = planes.T
    a = a.view(_u64 if rising or width > 4 else np.uint32).ravel()
    return _narrow(np.cumsum(a, dtype=_u64)) if rising else a


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) if not len(a) or int(a.max()) < 1 << 32 else a


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# -- counting ---------------------------------------------------------------------------------


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    out = np.ones(len(sorted_columns[0]), bool)
    out[1:] = False
    for c in sorted_columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order of rows by two non-negative columns."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in (first, second)]
    if sum(bits) <= 64 and bits[1] < 64:
        word = first.astype(_u64) << _u64(bits[1])
        word |= second.astype(_u64)
        return np.argsort(word)
    return np.lexsort((second, first))


def _sequence(batch: pa.RecordBatch, limit: int = W.CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk: word hashes with the end token after each text, and the ranges of the texts."""
    for i, j, data, off in W.chunks(batch.column("text"), limit):
        start, end, rows = W.spans(data, off, W.SPACED)
        at = rows + np.arange(len(rows))
        h = np.empty(at[-1], _u64)
        h[:] = END[0]
        words = np.ones(len(h), bool)
        words[at[1:] - 1] = False
        h[np.flatnonzero(words)] = W.hashes(data, start, end)
        yield i, j, h, at


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and text starts of about ``GATHER`` tokens at a time."""
    held, heads, n = [], [], 0
    for b in batches:
        for _, _, h, at in _sequence(b):
            held.append(h)
            heads.append(at[:-1] + n)
            n += len(h)
            if n >= GATHER:
                yield np.concatenate(held), np.concatenate(heads)
                held, heads, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(heads)


def _quantise(p: np.ndarray) -> np.ndarray:
    """8-bit codes, 0 for the largest; the decoded value never exceeds p by more than half a step."""
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / DECADES * 255), 0, 255).astype(np.uint8)


_DECODE = 10.0 ** (-np.arange(256) / 255 * DECADES)


def _tree(parent: np.ndarray, child: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Pointers and children of one shard of a level: parents are 0..n-1, (parent, child) ascending."""
    pointer = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=n))])
    # children of each parent are offset by the last value before them, so the whole sequence is monotone
    last = np.zeros(n, np.int64)
    some = pointer[1:] > pointer[:-1]
    last[some] = child[pointer[1:][some] - 1].astype(np.int64) + 1
    base = np.cumsum(last) - last
    return {f"pointer.{k}": v for k, v in EF.build(pointer).items()} | {f"child.{k}": v for k, v in EF.build(base[parent] + child).items()}


def _weights(parent: np.ndarray, count: np.ndarray, context: np.ndarray, discount: float) -> dict[str, np.ndarray]:
    """Codes of the children and backoff weights of the parents, whose counts are ``context``."""
    code = np.empty(len(parent), np.uint8)
    for i in range(0, len(parent), 1 << 18):
        part = slice(i, i + (1 << 18))
        code[part] = _quantise((count[part] - discount) / context[parent[part]])
    total = lambda: np.bincount(parent, _DECODE[code], len(context))
    mass = total()
    # rounding up may overfill a context: lower its codes until the backoff is positive
    while (over := mass > 0.999).any():
        hit = over[parent] & (code < 255)
        if not hit.any():
            break
        code[hit] += 1
        mass = total()
    return {"code": code, "backoff": np.maximum(np.rint((1 - mass) * 65535), 1).astype(np.uint16)}


def _discount(one: int, two: int) -> float:
    return float(np.clip(one / max(1, one + 2 * two), 0.1, 0.9))


# -- the model --------------------------------------------------------------------------------


class _Shard:
    """One shard of a level, as mapped."""

    def __init__(self, tree: dict, weights: dict | None = None):
        pick = lambda p: {k.split(".", 1)[1]: v for k, v in tree.items() if k.startswith(p)}
        self.pointer, self.child = EF.EliasFano(pick("pointer.")), EF.EliasFano(pick("child."))
        if weights is not None:
            self.code, self.backoff = weights["code"], weights["backoff"]

    def find(self, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each (parent, child) or -1, first index of each parent's children); sorted by parent."""
        head = _heads(parent)
        back = W.ranks(head)
        lo, hi = (x.astype(np.int64) for x in self.pointer.get_two(parent.compress(head)))
        base = np.zeros(len(lo), _u64)
        before = np.flatnonzero((lo > 0) & (hi > lo))
        base[before] = self.child.get(lo[before] - 1) + _u64(1)
        lo = lo[back]
        at = self.child.find(base[back] + child.astype(_u64))
        return np.where((at >= lo) & (at < hi[back]), at, -1), lo

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(parent, child) of all entries."""
        pointer = self.pointer.all().astype(np.int64)
        value = self.child.all()
        size = np.diff(pointer)
        base = np.concatenate([[0], value + _u64(1)]).astype(_u64)[pointer[:-1]]
        return np.repeat(np.arange(len(size)), size), (value - np.repeat(base, size)).astype(np.int64)


class Trie:
    """A stored model; shards are opened when first needed."""

    def __init__(self, uri: str, meta: dict):
        self.uri, self.meta = uri, meta
        self.shift = _u64(64 - int(meta["shards"]).bit_length() + 1)
        self.starts = {k: np.asarray(meta[k], np.int64) for k in ("words", "pairs", "ranges") if k in meta}
        self._open: dict[str, object] = {}
        self._held = 0

    def _load(self, name: str) -> dict:
        arrays, held = load(f"{self.uri}/{name}.bin")
        if self._held + held > HELD_BYTES:  # only where shards are read instead of mapped
            self._open.clear()
            self._held = 0
        self._held += held
        return arrays

    def shard_bounds(self, h: np.ndarray) -> np.ndarray:
        """Bounds of the shards within ascending hashes."""
        if self.meta["shards"] == 1:
            return np.array([0, len(h)])
        return np.searchsorted(h >> self.shift, np.arange(self.meta["shards"] + 1, dtype=_u64))

    def words(self, s: int) -> dict:
        key = f"words-{s}"
        if key not in self._open:
            self._open[key] = self._load(key)
        return self._open[key]

    def level(self, n: int, s: int) -> _Shard:
        key = f"level{n}-{s}"
        if key not in self._open:
            self._open[key] = _Shard(self._load(f"tree{n}-{s}"), self._load(f"weights{n}-{s}"))
        return self._open[key]

    def lookup(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, training count) of ascending word hashes."""
        ids, counts = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
        bounds = self.shard_bounds(own)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            if self.starts["words"][s] == self.starts["words"][s + 1]:
                continue
            a, b = bounds[s], bounds[s + 1]
            known = self.words(s)
            at = np.minimum(np.searchsorted(known["hash"], own[a:b]), len(known["hash"]) - 1)
            ok = known["hash"][at] == own[a:b]
            ids[a:b] = np.where(ok, at + self.starts["words"][s], -1)
            counts[a:b] = np.where(ok, known["count"][at], 0)
        return ids, counts

    def _find(self, n: int, starts: np.ndarray, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, ...]:
        """For ascending (parent, child): local index or -1, shard, discounted probability, rank among the parent's children."""
        at, shard = np.full(len(parent), -1, np.int64), np.zeros(len(parent), np.int64)
        q, rank = np.zeros(len(parent)), np.zeros(len(parent), np.int64)
        bounds = np.searchsorted(parent, starts)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[s], bounds[s + 1]
            lv = self.level(n, s)
            i, lo = lv.find(parent[a:b] - starts[s], child[a:b])
            hit = np.flatnonzero(i >= 0)
            at[a:b], rank[a:b], shard[a:b] = i, i - lo, s
            q[a + hit] = _DECODE[lv.code[i[hit]]]
        return at, shard, q, rank

    def _backoff(self, n: int, starts: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Backoff weight of ascending contexts."""
        out = np.ones(len(parent))
        bounds = np.searchsorted(parent, starts)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[s], bounds[s + 1]
            out[a:b] = self.level(n, s).backoff[parent[a:b] - starts[s]] / 65535
        return out

    def _step(self, n: int, starts: np.ndarray, parent: np.ndarray, child: np.ndarray, p: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One level down at ``pos``: weighs ``p`` by the contexts' backoff, adds what is known of (parent, child),
        and returns (positions of hits, their local index and shard, rank)."""
        order = _order(parent, child + 1)
        a, b = parent[order], child[order]
        head = _heads(a, b)
        back = np.empty(len(pos), np.int64)
        back[order] = W.ranks(head)
        a, b = a.compress(head), b.compress(head)
        first = _heads(a)
        weight = self._backoff(n, starts, a.compress(first))[W.ranks(first)]
        index, shard, q, rank = (np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64), np.zeros(len(a)), np.zeros(len(a), np.int64))
        known = np.flatnonzero(b >= 0)
        index[known], shard[known], q[known], rank[known] = self._find(n, starts, a[known], b[known])
        p[pos] = p[pos] * weight[back] + q[back]
        hit = np.flatnonzero(index[back] >= 0)
        return pos[hit], (self.starts["pairs"][shard] + index)[back[hit]] if n == 2 else hit, rank[back[hit]]

    def log_probabilities(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 p, base log10 p, training count) of each token of texts at ``at``."""
        own, _, back = W.distinct(h)
        ids, counts = self.lookup(own) if self.meta["types"] else (np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64))
        total = self.meta["tokens"] + 0.5 * (self.meta["types"] + 1)
        ids, counts = ids[back], counts[back]
        first = (counts + 0.5) / total if self.meta["types"] else np.ones(len(h))
        p = first.copy()
        if self.meta["types"]:
            head = np.zeros(len(h), bool)
            head[at[:-1]] = True
            pos = np.flatnonzero(~head)
            pos = pos.compress(ids[pos - 1] >= 0)
            pos, index, rank = self._step(2, self.starts["words"], ids[pos - 1], ids[pos], p, pos)
            # contexts of two words: every position after a kept pair; the next word is known by its rank, -1 where it is no successor
            pair, order = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
            pair[pos], order[pos] = index, rank
            pos = np.flatnonzero(~head[1:] & (pair[:-1] >= 0)) + 1
            if len(pos):
                self._step(3, self.starts["ranges"], pair[pos - 1], order[pos], p, pos)
        return np.log10(p), np.log10(first), counts


_tries: dict[str, Trie] = {}


def opened(uri: str, meta: dict) -> Trie:
    key = f"{uri}#{len(meta)}"
    if key not in _tries:
        _tries.clear()
        _tries[key] = Trie(uri, meta)
    return _tries[key]


def _starts(rows, shards: int, column: str) -> list[int]:
    n = dict((r["shard"], r[column]) for r in rows)
    return np.concatenate([[0], np.cumsum([n.get(s, 0) for s in range(shards)], dtype=np.int64)]).tolist()


def _by_shard(table: pa.Table, column: str) -> list:
    return table.column(column).to_pylist()


def _count_words(uri: str, meta: dict):
    def count(batches):
        trie = Trie(uri, meta)
        for h, _ in _gathered(batches):
            h.sort()
            at = np.flatnonzero(_heads(h))
            n = np.diff(np.append(at, len(h)))
            own = h[at]
            bounds = trie.shard_bounds(own)
            live = np.flatnonzero(np.diff(bounds)).tolist()
            cols = [[_squeeze(own[bounds[s] : bounds[s + 1]], True) for s in live], [_squeeze(n[bounds[s] : bounds[s + 1]]) for s in live]]
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["shard", "keys", "counts"])

    return count


def _merge_words(uri: str):
    def merge(key, table):
        s = key[0].as_py()
        keys = np.concatenate([_expand(x, True).astype(_u64) for x in _by_shard(table, "keys")])
        counts = _joined([_expand(x) for x in _by_shard(table, "counts")]).astype(np.int64)
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(_heads(keys))
        n = np.add.reduceat(counts[order], at)
        save(f"{uri}/words-{s}.bin", {"hash": keys[at], "count": n})
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(n)]), "total": pa.array([int(n.sum())])})

    return merge


def _mix(a: np.ndarray) -> np.ndarray:
    return ((a.astype(_u64) * _u64(0x9E3779B97F4A7C15)) >> _u64(33)).astype(np.int64)


def _owner(starts, at) -> np.ndarray:
    """Which of the ranges that begin at ``starts`` holds each place."""
    return np.searchsorted(starts, at, "right") - 1


_PARTS = "shard int, one long, two long"
_TREES = "shard int, n long, one2 long, two2 long, one3 long, two3 long, cut array<long>, first array<long>, second array<long>"
_TRIPLES = "part long, b binary, c binary, many binary, before binary, counts binary"
_PASSED = "range long, source int, first binary, second binary, rank binary, counts binary"


def _read(table: pa.Table, name: str, rising: bool = False) -> list[np.ndarray]:
    return [_expand(x, rising) for x in _by_shard(table, name) if x is not None]


def _count_triples(uri: str, meta: dict):
    """Triples by middle word, third word, first word (plus one; 0 before the text), with their counts, for the parts
    of the middle words' shards: a shard of k * k parts is dealt by the third word and by the first."""

    def count(batches):
        trie = opened(uri, meta)
        starts, parts, sides = trie.starts["words"], np.asarray(meta["parts"]), np.asarray(meta["sides"])
        for h, heads in _gathered(batches):
            own, _, back = W.distinct(h)
            ids = trie.lookup(own)[0][back]
            head = np.zeros(len(h), bool)
            head[heads] = True
            pos = np.flatnonzero(~head)
            if not len(pos):
                continue
            before = np.where(head[pos - 1], 0, ids[pos - 2] + 1)
            b, c = ids[pos - 1], ids[pos]
            order = _order(b, c)
            b, c, before = b[order], c[order], before[order]
            pair = _heads(b, c)
            group = W.ranks(pair)
            inner = _order(group, before)
            group, before = group[inner], before[inner]
            at = np.flatnonzero(_heads(group, before))
            n = np.diff(np.append(at, len(group)))
            group, before, b, c = group[at], before[at], b.compress(pair), c.compress(pair)
            shard = _owner(starts, b)
            side = sides[shard]
            part = (parts[shard] + _mix(c) % side * side)[group] + _mix(before) % side[group]
            order = np.argsort(part, kind="stable")
            part, group, before, n = part[order], group[order], before[order], n[order]
            pair = np.flatnonzero(_heads(part, group))
            ends, own, group = np.append(pair, len(part)), part[pair], group[pair]
            b, c, many = b[group] - starts[shard[group]], c[group], np.diff(ends)
            cut = np.append(np.flatnonzero(_heads(own)), len(own))
            rows = {"part": own[cut[:-1]], "b": [], "c": [], "many": [], "before": [], "counts": []}
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                x, y = ends[i], ends[j]
                for name, blob in (("b", _squeeze(b[i:j], True)), ("c", _squeeze(c[i:j])), ("many", _squeeze(many[i:j])), ("before", _squeeze(before[x:y])), ("counts", _squeeze(n[x:y]))):
                    rows[name].append(blob)
            yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int64()), *(pa.array(rows[k], pa.binary()) for k in ("b", "c", "many", "before", "counts"))], names=list(rows))

    return count


def _stored(uri: str, part: int) -> dict[str, np.ndarray]:
    """The triples of a part."""
    return {k: _expand(v.tobytes(), k == "b") for k, v in load(f"{uri}/counted/{part}.bin")[0].items()}


def _merge_part(uri: str, meta: dict):
    """One part: stores its triples, each of which is in no other part."""

    def merge(key, table):
        part = key[0].as_py()
        b, c, many = _joined(_read(table, "b", True)), _joined(_read(table, "c")), _joined(_read(table, "many"))
        order = _order(b, c)
        head = _heads(b[order], c[order])
        group = np.empty(len(b), np.uint32)
        group[order] = W.ranks(head)
        b, c = b[order].compress(head), c[order].compress(head)
        group, before = np.repeat(group, many), _joined(_read(table, "before"))
        order = _order(group, before)
        n = _joined(_read(table, "counts"))[order].astype(np.int64)
        group, before = group[order], before[order]
        del order, many, head
        at = np.flatnonzero(_heads(group, before))
        n = np.add.reduceat(n, at) if len(at) else n
        group, before = group[at], before[at]
        own = n[before > 0]
        blobs = {"b": _squeeze(b, True), "c": _squeeze(c), "many": _squeeze(np.bincount(group, minlength=len(b))), "before": _squeeze(before), "counts": _squeeze(n)}
        save(f"{uri}/counted/{part}.bin", {k: np.frombuffer(v, np.uint8) for k, v in blobs.items()})
        cols = {"shard": pa.array([int(_owner(meta["parts"], part))], pa.int32())}
        return pa.table(cols | {k: pa.array([int((own == m).sum())]) for k, m in (("one", 1), ("two", 2))})

    return merge


def _merge_pairs(uri: str, meta: dict, least: int):
    """The pairs of shard ``s``, from its stored parts, as a tree cut into ranges of about as many tokens as a task shall hold."""

    def merge(key, table):
        s = key[0].as_py()
        starts = opened(uri, meta).starts["words"]
        held = []
        for part in range(meta["parts"][s], meta["parts"][s + 1]):
            t = _stored(uri, part)
            ends = np.cumsum(t["many"], dtype=np.int64)
            held.append((t["b"], t["c"], np.add.reduceat(t["counts"].astype(np.int64), ends - t["many"]) if len(ends) else ends))
        b, c, n = map(_joined, zip(*held))
        order = _order(b, c)
        b, c, n = b[order], c[order], n[order]
        del held, t, ends, order
        at = np.flatnonzero(_heads(b, c))
        b, c, n = b[at], c[at], np.add.reduceat(n, at) if len(at) else n
        stats = {"one2": int((n == 1).sum()), "two2": int((n == 2).sum()), "one3": sum(_by_shard(table, "one")), "two3": sum(_by_shard(table, "two"))}
        keep = n >= least
        b, c, n = b.compress(keep), c.compress(keep), n.compress(keep)
        save(f"{uri}/tree2-{s}.bin", _tree(b, c, int(starts[s + 1] - starts[s])))
        save(f"{uri}/counted/pairs-{s}.bin", {"n": np.frombuffer(_squeeze(n), np.uint8)})
        cut = np.flatnonzero(_heads((np.cumsum(n) - n) // meta["task_tokens"]))
        lists = {"cut": cut, "first": b[cut].astype(np.int64) + starts[s], "second": c[cut]}
        cols = {"shard": pa.array([s], pa.int32()), "n": pa.array([len(n)])} | {k: pa.array([v], pa.int64()) for k, v in stats.items()}
        return pa.table(cols | {k: pa.array([v.tolist()], pa.list_(pa.int64())) for k, v in lists.items()})

    return merge


def _pair_counts(uri: str, s: int) -> np.ndarray:
    return _expand(load(f"{uri}/counted/pairs-{s}.bin")[0]["n"].tobytes()).astype(np.int64)


def _pass_on(uri: str, meta: dict, least: int):
    """The triples of each part, with the rank of their third word in place of it, for the ranges of their first two."""

    def run(batches):
        starts = np.asarray(meta["words"])
        cuts = [np.asarray(meta[k], np.int64) for k in ("first", "second")]
        for part in (x for batch in batches for x in batch.column(0).to_pylist()):
            s = int(_owner(meta["parts"], part))
            t = _stored(uri, part)
            at, lo = _Shard(load(f"{uri}/tree2-{s}.bin")[0]).find(t["b"].astype(np.int64), t["c"].astype(np.int64)) if len(t["b"]) else (t["b"], t["b"])
            group = np.repeat(np.arange(len(t["b"]), dtype=np.uint32), t["many"])
            keep = (t["before"] > 0) & (at[group] >= 0) & (t["counts"] >= least)
            group, first, n = group.compress(keep), t["before"].compress(keep) - 1, t["counts"].compress(keep)
            if not len(n):
                continue
            # a triple's range is that of the last cut not after its first two words: both are sorted together, cuts first
            second = t["b"][group].astype(np.int64) + starts[s]
            order = _order(np.concatenate([cuts[0], first]), np.concatenate([2 * cuts[1], 2 * second + 1]))
            place = np.cumsum(order < len(cuts[0])) - 1
            rows = order >= len(cuts[0])
            owner, order = place.compress(rows), order.compress(rows) - len(cuts[0])
            group, first, second, n = group[order], first[order], second[order] - starts[s], n[order]
            rank = (at - lo)[group]
            cut = np.append(np.flatnonzero(_heads(owner)), len(owner))
            blobs = {"first": [], "second": [], "rank": [], "counts": []}
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                for name, blob in (("first", _squeeze(first[i:j], True)), ("second", _squeeze(second[i:j])), ("rank", _squeeze(rank[i:j])), ("counts", _squeeze(n[i:j]))):
                    blobs[name].append(blob)
            head = [pa.array(owner[cut[:-1]], pa.int64()), pa.array([s] * (len(cut) - 1), pa.int32())]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(v, pa.binary()) for v in blobs.values())], names=["range", "source", *blobs])

    return run


def _merge_range(uri: str, meta: dict):
    """One range of pairs: its triples as a tree with weights."""

    def merge(key, table):
        r = key[0].as_py()
        starts = np.asarray(meta["words"])
        s = int(_owner(meta["pairs"], meta["ranges"][r]))
        begin, end = (meta["ranges"][x] - meta["pairs"][s] for x in (r, r + 1))
        table = table.filter(table.column("source").is_valid())
        first = _joined(_read(table, "first", True)).astype(np.int64) - starts[s]
        second = _joined([_narrow(x + starts[k]) for x, k in zip(_read(table, "second"), _by_shard(table, "source"))])
        order = _order(first, second)
        a, b = first[order], second[order]
        del first, second
        index = np.empty(len(order), np.int64)
        if len(order):
            head = _heads(a, b)
            place = _Shard(load(f"{uri}/tree2-{s}.bin")[0]).find(a.compress(head), b.compress(head).astype(np.int64))[0]
            index[order] = place[W.ranks(head)] - begin
            del head, place
        del a, b
        rank = _joined(_read(table, "rank"))
        order = _order(index, rank)
        index, rank = index[order], rank[order]
        save(f"{uri}/tree3-{r}.bin", _tree(index, rank, end - begin))
        del rank
        n = _joined(_read(table, "counts"))[order]
        context = _pair_counts(uri, s)[begin:end]
        save(f"{uri}/weights3-{r}.bin", _weights(index, n, context, meta["discounts"][1]))
        return pa.table({"range": pa.array([r], pa.int64()), "triples": pa.array([len(index)])})

    return merge


def _weigh_pairs(uri: str, meta: dict):
    """The weights of the pairs of each shard."""

    def run(batches):
        trie = opened(uri, meta)
        for s in (x for batch in batches for x in batch.column(0).to_pylist()):
            sizes = np.diff(_Shard(load(f"{uri}/tree2-{s}.bin")[0]).pointer.all().astype(np.int64))
            some = meta["words"][s + 1] > meta["words"][s]
            context = trie.words(s)["count"] if some else np.zeros(0, np.int64)
            save(f"{uri}/weights2-{s}.bin", _weights(np.repeat(np.arange(len(sizes)), sizes), _pair_counts(uri, s), context, meta["discounts"][0]))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int64())})

    return run


def train(docs: DataFrame, least: int = MIN_COUNT, task_tokens: int = TASK_TOKENS) -> tuple[str, dict]:
    """Build the trie over all rows of ``docs(text)``, without pairs and triples of fewer than ``least``
    occurrences (the query keeps them all); returns its folder and directory.  Groups hold about ``task_tokens``
    tokens, however often a word or pair occurs."""
    spark = docs.sparkSession
    uri = scratch(spark, "ngram-trie")
    text = docs.select("text")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    meta: dict = {"shards": 1 << math.ceil(math.log2(max(width, size / (TOKEN_BYTES * task_tokens)))), "task_tokens": task_tokens}
    rows = text.mapInArrow(released(_count_words(uri, meta)), "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(_merge_words(uri), "shard int, n long, total long").collect()
    meta |= {"words": _starts(rows, meta["shards"], "n"), "types": sum(r["n"] for r in rows), "tokens": sum(r["total"] for r in rows)}
    if not rows:
        return uri, meta
    total = np.diff(_starts(rows, meta["shards"], "total"))
    sides = np.maximum(1, np.ceil(np.sqrt(total / task_tokens))).astype(np.int64)
    meta |= {"sides": sides.tolist(), "parts": np.concatenate([[0], np.cumsum(sides**2)]).tolist()}

    def every(n: int) -> DataFrame:
        return spark.range(0, n, 1, min(n, 4 * width))

    # every part and range gets its files, with or without triples
    none = [F.lit(None).cast("binary").alias(k) for k in ("b", "c", "many", "before", "counts")]
    counted = text.mapInArrow(released(_count_triples(uri, dict(meta))), _TRIPLES).unionByName(every(meta["parts"][-1]).select(F.col("id").alias("part"), *none))
    parts = counted.groupBy("part").applyInArrow(_merge_part(uri, dict(meta)), _PARTS)
    rows = sorted(parts.groupBy("shard").applyInArrow(_merge_pairs(uri, dict(meta), least), _TREES).collect(), key=lambda r: r["shard"])
    meta["pairs"] = _starts(rows, meta["shards"], "n")
    meta["discounts"] = [_discount(sum(r[a] for r in rows), sum(r[b] for r in rows)) for a, b in (("one2", "two2"), ("one3", "two3"))]
    meta["ranges"] = [meta["pairs"][r["shard"]] + x for r in rows for x in r["cut"]] + [meta["pairs"][-1]]
    meta |= {k: [x for r in rows for x in r[k]] for k in ("first", "second")}
    every(meta["shards"]).mapInArrow(released(_weigh_pairs(uri, dict(meta))), "shard long").count()
    ranges = len(meta["ranges"]) - 1
    if ranges:
        none = [F.lit(None).cast("int").alias("source"), *(F.lit(None).cast("binary").alias(k) for k in ("first", "second", "rank", "counts"))]
        passed = every(meta["parts"][-1]).mapInArrow(released(_pass_on(uri, dict(meta), least)), _PASSED).unionByName(every(ranges).select(F.col("id").alias("range"), *none))
        rows = passed.groupBy("range").applyInArrow(_merge_range(uri, dict(meta)), "range long, triples long").collect()
    meta["triples"] = np.concatenate([[0], np.cumsum([r["triples"] for r in sorted(rows, key=lambda r: r["range"])] if ranges else [], dtype=np.int64)]).tolist()
    discard(spark, f"{uri}/counted")
    return uri, {k: v for k, v in meta.items() if k not in ("first", "second")}


def score(docs: DataFrame, uri: str, meta: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        trie = opened(uri, meta)
        for b in batches:
            for i, j, h, at in _sequence(b, SCORE_BYTES):
                p, base, counts = trie.log_probabilities(h, at)
                head = at[:-1]
                n = np.diff(at)
                cols = [n, np.add.reduceat((counts > 0).astype(np.int64), head), np.full(j - i, meta["tokens"], np.int64), np.add.reduceat(base, head), np.add.reduceat(p, head)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), *map(pa.array, cols)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(
        released(run), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op6_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    uri, meta = train(docs.where(~held_out(1, 5)))
    out = score(docs, uri, meta)
    return out.select("doc_id", held_out(1, 5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
