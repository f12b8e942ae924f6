"""Token ids in a grammar-compressed binary format (Re-Pair per shard).

Documents are range-partitioned and sorted by ``doc_id``; each partition writes shards of a few
megabytes of whole documents.  A shard repeatedly replaces its most frequent id pairs by
nonterminals and stores the rules, the expansion length of every symbol and the reduced
sequence, so any id range decodes without expanding the rest.  Shards are rows of a Parquet
table (part, shard, doc_ids, lengths, payload) in the shared folder: Spark's committer makes
each write whole or absent, and any reader of the cluster can open it.

Payload, little-endian: ``GRP1``, base u32, rules u32, symbols u32, symbol width u32 (2 bytes, or the bits of a
symbol, 17 to 32, packed from the lowest);
rules as u32 pairs; expansion length of each rule as u32; the sequence.  Symbol ``base + r`` is rule r.

Defined results
---------------
* Null and empty texts are just the end id.  Special-token strings inside a text become the vocabulary's added tokens.
* Rows that repeat a ``doc_id`` are adjacent, ordered by text; a null ``doc_id`` comes first.
* An empty table writes no shards and reads back as an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.runtime import materialise, released

END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: a pair is frequent, so that its rule (12 bytes) pays, from this number of occurrences on
MIN_PAIRS = 8
#: text of a shard, and text encoded at once
SHARD_BYTES = 1 << 20
CHUNK_BYTES = 1 << 19
#: distinct pieces a worker remembers (bounds its memory); beyond it, those not seen again are forgotten
MEMO = 600_000

_u64 = np.uint64
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = range(5)


def _classes() -> np.ndarray:
    """Class of each code point below 0x10000 that Unicode has long settled; all others, and control characters,
    are left to the library."""
    import unicodedata

    known = {"L": _LETTER, "N": _NUMBER, "P": _OTHER, "S": _OTHER, "M": _OTHER}
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    t = np.full(0x10000, _UNSURE, np.uint8)
    for c in range(0x20, 0x10000):
        x = chr(c)
        if new(x)[0] == old(x)[0]:
            t[c] = known.get(new(x)[0], _UNSURE)
    t[[9, 10, 13, 32]] = _SPACE
    return t


def _alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself if printable in
    Latin-1, else the next of those from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]`` one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _gather_many(flat: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """``_gather`` of many runs, some at a time: its places take 24 bytes an element while it works."""
    parts = [_gather(flat, start[k : k + step], size[k : k + step]) for k in range(0, len(start), step)]
    return np.concatenate([flat[:0], *parts])


class _Memo:
    """Ids of pieces by their hash, in flat arrays that grow by half; the bytes of each piece are kept to tell equal
    hashes apart.  New keys wait in a small index of their own until they are worth merging into the large one."""

    def __init__(self):
        self.keys, self.slots = np.zeros(0, _u64), np.zeros(0, np.int32)
        self.late_keys, self.late_slots = self.keys, self.slots
        self.start, self.size, self.begin, self.length = (np.zeros(0, np.int32) for _ in range(4))
        self.ids, self.text, self.again = np.zeros(0, np.uint32), np.zeros(8, np.uint8), np.zeros(0, bool)
        self.n = self.n_ids = self.n_text = 0

    def _room(self, name: str, need: int) -> np.ndarray:
        a = getattr(self, name)
        if len(a) < need:
            a = np.concatenate([a, np.zeros(need + need // 2 - len(a), a.dtype)])
            setattr(self, name, a)
        return a

    def add(self, text: bytes, length: np.ndarray, ids, size: np.ndarray) -> np.ndarray:
        """Slots of new pieces, given back to back with their ids."""
        n, m = self.n, self.n + len(size)
        for name, values in (("start", self.n_ids + np.cumsum(size) - size), ("begin", self.n_text + np.cumsum(length) - length), ("size", size), ("length", length), ("again", False)):
            self._room(name, m)[n:m] = values
        self._room("ids", self.n_ids + len(ids))[self.n_ids : self.n_ids + len(ids)] = ids
        self._room("text", self.n_text + len(text) + 8)[self.n_text : self.n_text + len(text)] = np.frombuffer(text, np.uint8)
        self.n, self.n_ids, self.n_text = m, self.n_ids + len(ids), self.n_text + len(text)
        return np.arange(n, m, dtype=np.int32)

    def index(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Enter ascending new keys."""
        at = np.searchsorted(self.late_keys, keys)
        self.late_keys, self.late_slots = np.insert(self.late_keys, at, keys), np.insert(self.late_slots, at, slots)
        if len(self.late_keys) > 5_000 + len(self.keys) // 8:
            at = np.searchsorted(self.keys, self.late_keys)
            self.keys, self.slots = np.insert(self.keys, at, self.late_keys), np.insert(self.slots, at, self.late_slots)
            self.late_keys, self.late_slots = self.keys[:0], self.slots[:0]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where unknown."""
        out = np.full(len(keys), -1, np.int32)
        for known, slots in ((self.keys, self.slots), (self.late_keys, self.late_slots)):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = slots[at[hit]]
        return out

    def forget(self) -> None:
        """Keep the pieces that were seen again since the last time, unless those are many themselves."""
        keep = self.again[: self.n] & (self.again[: self.n].sum() < MEMO // 2)
        keys, slots = np.concatenate([self.keys, self.late_keys]), np.concatenate([self.slots, self.late_slots])
        live = np.flatnonzero(keep[slots])
        live = live[np.argsort(keys[live])]
        old, to = (self.start[: self.n][keep], self.size[: self.n][keep], self.begin[: self.n][keep], self.length[: self.n][keep]), np.cumsum(keep) - 1
        ids, text = _gather_many(self.ids, *old[:2]), _gather_many(self.text, *old[2:])
        keys, slots = keys[live], to[slots[live]].astype(np.int32)
        self.__init__()
        self.add(text.tobytes(), old[3], ids, old[1])
        self.keys, self.slots = keys, slots

    def other(self, data: np.ndarray, s: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Places whose piece is not the one of its slot.  Up to 7 bytes a hash has one piece only."""
        long = np.flatnonzero(size > 7)
        bad = self.length[slot[long]] != size[long]
        here, there = W.blocks(data), np.ndarray((len(self.text) - 7,), "<u8", self.text, strides=(1,))
        at, live = 0, np.flatnonzero(~bad)
        while len(live):
            k = long[live]
            mask = W._MASK[np.minimum(size[k] - at, 8)]
            bad[live] |= (here[s[k] + at] & mask) != (there[self.begin[slot[k]] + at] & mask)
            at += 8
            live = live[(size[k] > at) & ~bad[live]]
        return long[bad]


class Encoder:
    """Byte-level BPE through the tokenizers library, with each distinct piece encoded once.

    The library splits a text into pieces and encodes piece by piece; the split is redone here
    on whole chunks with array operations for texts of common characters, and all other texts,
    and those that hold an added token, go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.cls = _classes()
        self.alphabet = _alphabet()
        self.memo = _Memo()

    def _learn(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Slots of new pieces, encoded by the library's own model in its alphabet of bytes."""
        n = e - s
        text = _gather(data, s, n).tobytes()
        letters, ends = text.decode("latin-1").translate(self.alphabet), np.cumsum(n)
        tokenize, flat, size = self.tok.model.tokenize, [], []
        for i, j in zip((ends - n).tolist(), ends.tolist()):
            ids = [t.id for t in tokenize(letters[i:j])]
            flat += ids
            size.append(len(ids))
        return self.memo.add(text, n, flat, np.array(size, np.int64))

    def _classify(self, data: np.ndarray) -> np.ndarray:
        """Class of each byte: that of the character it belongs to."""
        cls = self.cls[:256][data]
        high = np.flatnonzero(data >= 0x80)
        if len(high):
            b = data[high]
            cls[high] = _UNSURE
            two, three = high[(b >= 0xC2) & (b < 0xE0)], high[(b >= 0xE0) & (b < 0xF0)]
            wide = data.astype(np.uint32) if len(high) > len(data) // 4 else data
            byte = lambda at: wide[at].astype(np.uint32) & 0x3F
            c = self.cls[((byte(two) & 0x1F) << 6) | byte(two + 1)]
            cls[two], cls[two + 1] = c, c
            c = self.cls[((byte(three) & 0x0F) << 12) | (byte(three + 1) << 6) | byte(three + 2)]
            cls[three], cls[three + 1], cls[three + 2] = c, c, c
        return cls

    def split(self, data: np.ndarray, off: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each byte of texts at ``off`` (right for texts whose classes are all sure)."""
        n = len(data)
        head = np.zeros(n + 1, bool)
        head[off] = True
        head = head[:n]
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        start |= head
        # the last of a run of spaces goes with what follows if it is a blank, else stands alone
        b = np.flatnonzero((cls[1:] != _SPACE) & (cls[:-1] == _SPACE) & ~head[1:]) + 1
        start[b - 1] = True
        start[b.compress(data[b - 1] == 32)] = False
        # contractions: a piece that begins with an apostrophe, before a letter
        a = np.flatnonzero((data[:-1] == 39) & start[:-1] & (cls[1:] == _LETTER) & ~head[1:])
        if len(a):
            one, two = data[a + 1], data[np.minimum(a + 2, n - 1)]
            two_in = (a + 2 < n) & ~head[np.minimum(a + 2, n - 1)]
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
            for x, y in ("re", "ve", "ll"):
                size = np.where((one == ord(x)) & (two == ord(y)) & two_in, 3, size)
            a, size = a[size > 0], size[size > 0]
            start[a + 1] = False
            after = a + size
            start[after[after < n]] = True
        return start

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids with an end id after each text, number of ids of each text)."""
        data, off = W.flat(texts)
        rows = len(off) - 1
        unsure = np.zeros(rows, bool)
        if len(data):
            cls = self._classify(data)
            unsure[np.unique(np.searchsorted(off, np.flatnonzero(cls == _UNSURE), "right") - 1)] = True
            whole = data.tobytes() if self.added else b""
            for token in self.added:
                place = whole.find(token)
                while place >= 0:
                    unsure[np.searchsorted(off, place, "right") - 1] = True
                    place = whole.find(token, place + 1)
        direct = {int(r): self.tok.encode(data[off[r] : off[r + 1]].tobytes().decode(), add_special_tokens=False).ids for r in np.flatnonzero(unsure)}
        ids, counts = np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        if len(data) and not unsure.all():
            s = np.flatnonzero(self.split(data, off, cls))
            e = np.append(s[1:], len(data))
            if direct:
                sure = ~unsure[np.searchsorted(off, s, "right") - 1]
                s, e = s[sure], e[sure]
            slot = self._slots(data, s, e)
            ids = _gather(self.memo.ids, self.memo.start[slot], self.memo.size[slot])
            bounds = np.concatenate([[0], np.cumsum(self.memo.size[slot])])
            counts = np.diff(bounds[np.searchsorted(s, off)])
        out_counts = counts.copy()
        for r, x in direct.items():
            out_counts[r] = len(x)
        out_counts += 1
        out = np.full(out_counts.sum(), END_ID, np.uint32)
        to = np.cumsum(out_counts) - out_counts
        fast = np.arange(len(ids)) + np.repeat(to - (np.cumsum(counts) - counts), counts)
        out[fast] = ids
        for r, x in direct.items():
            out[to[r] : to[r] + len(x)] = x
        return out, out_counts

    def _slots(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Slot in the memo of each piece."""
        keys, first, back = W.distinct(W.hashes(data, s, e, fold=False))
        memo = self.memo
        slots = memo.find(keys)
        new = np.flatnonzero(slots < 0)
        if memo.n + len(new) > MEMO and memo.n:
            memo.forget()
            slots = memo.find(keys)
            new = np.flatnonzero(slots < 0)
        memo.again[slots[slots >= 0]] = True
        if len(new):
            f = first[new]
            slots[new] = self._learn(data, s[f], e[f])
            memo.index(keys[new], slots[new])
        slot = slots[back]
        bad = memo.other(data, s, e - s, slot)
        if len(bad):  # another piece of the same hash: learned without a key
            slot[bad] = self._learn(data, s[bad], e[bad])
        return slot


def _pack(seq: np.ndarray, bits: int) -> bytes:
    out = []
    for at in range(0, len(seq), 1 << 16):  # a multiple of 8 symbols fills whole bytes
        part = seq[at : at + (1 << 16)]
        rows = part.astype("<u4").view(np.uint8).reshape(len(part), 4)
        out.append(np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def _unpack(payload: bytes, at: int, n: int, bits: int) -> np.ndarray:
    raw, seq = np.frombuffer(payload, np.uint8, offset=at), np.zeros(n, np.uint32)
    for i in range(0, n, 1 << 16):
        m = min(1 << 16, n - i)
        part = np.zeros((m, 32), np.uint8)
        part[:, :bits] = np.unpackbits(raw[i * bits // 8 : (i * bits + m * bits + 7) // 8], count=m * bits, bitorder="little").reshape(m, bits)
        seq[i : i + m] = np.packbits(part, axis=1, bitorder="little").view("<u4")[:, 0]
    return seq


def _sorted_pairs(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, pairs in that order); a pair is its two symbols, each in 32 bits."""
    bits, at = symbols.bit_length(), len(left).bit_length()
    if 2 * bits + at > 64:
        key = (left.astype(_u64) << _u64(32)) | right
        order = np.argsort(key)
        return order, key[order]
    # pair and place share one word, which sorts faster than an index does
    word = (((left.astype(_u64) << _u64(bits)) | right) << _u64(at)) | np.arange(len(left), dtype=_u64)
    word.sort()
    order = (word & _u64((1 << at) - 1)).view(np.int64)
    word >>= _u64(at)
    return order, ((word >> _u64(bits)) << _u64(32)) | (word & _u64((1 << bits) - 1))


def compress(ids: np.ndarray, least: int = MIN_PAIRS) -> bytes:
    """Re-Pair in rounds: count all pairs of the reduced sequence, and replace each occurrence of a frequent pair
    that is more frequent than the pairs it overlaps; repeat until no pair occurs ``least`` times.

    After the first round only pairs with a new symbol, and those that lost to a neighbour, can be frequent, so later
    rounds look at few places (``where``) and still count all of a pair's.  The sequence is rewritten after each round
    while many places change, and is a linked list (``after``, ``before``) from then on."""
    seq = ids.astype(np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 1
    rules, known, made = [np.zeros((0, 2), np.int64)], np.ones(1, np.int64), 0
    linked, gone = False, np.zeros(len(seq), bool)
    height = np.zeros(len(seq) + 2, np.uint32)  # rank of the frequent pair at each place, after a place before the first
    where = np.arange(max(0, len(seq) - 1))
    while len(where):
        left, right = seq[where], seq[after[where] if linked else where + 1]
        order, ranked = _sorted_pairs(left, right, base + made)
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        count = np.diff(np.append(edge, len(ranked)))
        often = count >= least
        if not often.any():
            break
        place = where[order.compress(np.repeat(often, count))]
        pairs, count = ranked[edge.compress(often)], count.compress(often)
        del order, ranked, edge  # the largest arrays of a worker
        own = np.repeat(np.arange(len(pairs)), count)
        rank = np.empty(len(pairs), np.uint32)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(pairs) + 1)
        mine = rank[own]
        height[place + 1] = mine
        # of overlapping occurrences of a pair (in a run of one symbol) every other one can win, from the left
        twin = where.compress(left == right)
        at = np.arange(len(twin))
        follows = np.zeros(len(twin), bool)
        follows[1:] = (after[twin[:-1]] if linked else twin[:-1] + 1) == twin[1:]
        odd = twin[(at - np.maximum.accumulate(np.where(follows, 0, at))) % 2 == 1]
        height[odd + 1] = 0
        del twin, at, follows
        won = (mine > height[before[place] + 1 if linked else place]) & (mine > height[after[place] + 1 if linked else place + 2])
        height[place + 1] = 0
        won = np.flatnonzero(won)
        times = np.bincount(own[won], minlength=len(pairs))
        left, right = (pairs >> _u64(32)).astype(np.int64), (pairs & _u64(0xFFFFFFFF)).astype(np.int64)
        used = times >= np.where(left == right, -(-least // 2), least)
        won = won.compress(used[own[won]])
        new = place[won]
        seq[new] = (base + made - 1 + np.cumsum(used)[own[won]]).astype(np.uint32)
        del mine, own, won
        dead = after[new] if linked else new + 1
        # next: the new symbols and what precedes them, and the losers that still begin a pair
        live = np.zeros(len(seq) + 1, bool)
        live[place] = live[odd] = True
        live[dead] = False
        gone[dead] = True
        if linked:
            after[new] = after[dead]
            before[after[new]] = new
            live[before[new]] = True
            where = np.flatnonzero(live[:-1])
            where = where.compress(after[where] < len(seq))
        else:
            live[new - 1] = True
            stay = ~gone
            seq, where = seq.compress(stay), np.flatnonzero(live[:-1].compress(stay)[:-1])
            gone = np.zeros(len(seq), bool)
            if linked := len(where) < len(seq) // 16:
                after, before = np.arange(1, len(seq) + 1), np.arange(-1, len(seq))
        table = np.column_stack([left, right])[used]
        rules.append(table)
        made += len(table)
        known = np.concatenate([known, known[np.maximum(table - base + 1, 0)].sum(axis=1)])
    seq = seq.compress(~gone)
    width = 2 if base + made <= 1 << 16 else (base + made - 1).bit_length()
    head = b"GRP1" + struct.pack("<4I", base, made, len(seq), width)
    table = np.concatenate(rules).astype("<u4")
    return head + table.tobytes() + known[1:].astype("<u4").tobytes() + (seq.astype("<u2").tobytes() if width == 2 else _pack(seq, width))


class Shard:
    """Random access to the ids of one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"GRP1":
            raise ValueError("not a token shard")
        self.base, made, n, width = struct.unpack_from("<4I", payload, 4)
        self.rules = np.frombuffer(payload, "<u4", 2 * made, 20).reshape(made, 2).astype(np.int64)
        self.lengths = np.frombuffer(payload, "<u4", made, 20 + 8 * made).astype(np.int64)
        self.seq = np.frombuffer(payload, "<u2", n, 20 + 12 * made) if width == 2 else _unpack(payload, 20 + 12 * made, n, width)
        self._sizes = np.concatenate([[1], self.lengths])
        self._ends = None

    def _size(self, symbols: np.ndarray) -> np.ndarray:
        return self._sizes[np.maximum(symbols - (self.base - 1), 0)]

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        symbol = seq.astype(np.int64)
        size = self._size(symbol)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        while len(symbol):  # ids go to their place; what a rule stands for takes the next turn
            rule = symbol >= self.base
            plain = np.flatnonzero(~rule)
            out[at[plain]] = symbol[plain]
            at = at.compress(rule)
            pair = self.rules[symbol.compress(rule) - self.base]
            symbol = np.concatenate([pair[:, 0], pair[:, 1]])
            at = np.concatenate([at, at + self._size(pair[:, 0])])
        return out

    def all(self) -> np.ndarray:
        """All ids: the rules are expanded once, then copied where they stand."""
        rules = self._expand(self.base + np.arange(len(self.rules)))
        flat = np.concatenate([np.arange(self.base, dtype=np.uint32), rules])
        start = np.concatenate([[self.base], self.base + np.cumsum(self.lengths)])[:-1]
        symbol = self.seq.astype(np.int64)
        size = self._size(symbol)
        rule = np.flatnonzero(symbol >= self.base)
        symbol[rule] = start[symbol[rule] - self.base]
        return _gather(flat, symbol, size)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids start..end; only the symbols that cover them are expanded."""
        if start == 0 and end is None:
            return self.all()
        if self._ends is None:
            self._ends = np.cumsum(self._size(self.seq.astype(np.int64)))
        total = int(self._ends[-1]) if len(self._ends) else 0
        end = total if end is None else min(end, total)
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self._ends, [start, end - 1], "right")
        skip = start - (int(self._ends[a - 1]) if a else 0)
        return self._expand(self.seq[a : b + 1])[skip : skip + end - start]


_encoders: dict[str, Encoder] = {}


def _writer(path: str | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

            file = public_tokenizers.path(VOCABULARY)
        else:
            file = path
        encoder = _encoders.get(file) or _encoders.setdefault(file, Encoder(file))
        part, shard = TaskContext.get().partitionId(), 0
        keep, size = [], 0

        def emit():
            kind = keep[0][0].type
            doc_ids = pa.concat_arrays([k for k, _, _ in keep])
            counts = np.concatenate([c for _, c, _ in keep])
            payload = compress(np.concatenate([i for _, _, i in keep]))
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(t))
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([shard]), one(doc_ids, kind), one(pa.array(counts), pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "shard", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            for i, j, data, off in W.chunks(batch.column("text"), CHUNK_BYTES):
                ids, counts = encoder.encode(batch.column("text").slice(i, j - i))
                keep.append((batch.column("doc_id").slice(i, j - i), counts, ids))
                size += len(data)
                if size >= SHARD_BYTES:
                    yield emit()
                    keep, size, shard = [], 0, shard + 1
        if keep:
            yield emit()

    return write


def write_shards(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and store the shards; returns the stored table.  ``vocabulary`` is the path of a
    tokenizers file (by default the public one)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text")
    ordered = ordered.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(released(_writer(vocabulary)), f"part long, shard long, doc_ids array<{kind}>, lengths array<long>, payload binary"), "token-shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            doc_ids = batch.column("doc_ids").slice(k, 1).flatten()
            n = batch.column("lengths").slice(k, 1).flatten().to_numpy()
            raw = memoryview(Shard(batch.column("payload")[k].as_py()).ids().astype("<u4").tobytes())
            end = np.cumsum(n)
            crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(end.tolist(), n.tolist())]
            fixed = [np.full(len(n), batch.column(c)[k].as_py(), np.int64) for c in ("part", "shard")]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, fixed), doc_ids, pa.array(end - n), pa.array(n), pa.array(crc, pa.int64())],
                names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from stored shards."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    per = shards.select("part", "shard", size.alias("size"))
    # parts are in doc_id order: a running sum over parts (one row each), then over the shards of a part
    parts = per.groupBy("part").agg(F.sum("size").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("p0"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = per.select("part", "shard", inside.alias("s0")).join(parts, "part").select("part", "shard", (F.col("p0") + F.col("s0")).alias("first"))
    rows = shards.select("part", "shard", "doc_ids", "lengths", "payload").mapInArrow(
        released(_read), f"part long, shard long, doc_id {kind}, at long, n_tokens long, ids_crc32 long"
    )
    return rows.join(first, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
