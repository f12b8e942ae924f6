"""Elias-Fano sequences over flat arrays, with vectorised access and successor search.

A monotone sequence of n values below U keeps floor(log2(U / n)) low bits of each value packed,
and the high parts in unary: bit ``high[i] + i`` is set.  One rank count per 64-bit word makes
select a binary search.  All parts are plain arrays, so a sequence can be used straight from a
memory-mapped file.
"""

from __future__ import annotations

import numpy as np

_u64 = np.uint64
#: place of the r-th set bit of each byte value
_PLACE = np.array([([k for k in range(8) if b >> k & 1] + [8] * 8)[:8] for b in range(256)], np.int64)
_1, _2, _4, _8, _63, _64 = (_u64(k) for k in (1, 2, 4, 8, 63, 64))
_ONES, _TOPS = _u64(0x0101010101010101), _u64(0x8080808080808080)
_M5, _M3, _MF = _u64(0x5555555555555555), _u64(0x3333333333333333), _u64(0x0F0F0F0F0F0F0F0F)


def _select(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each word: byte sums side by side in one word, then a table for the byte."""
    s = word - ((word >> _1) & _M5)
    s = (s & _M3) + ((s >> _2) & _M3)
    s = ((s + (s >> _4)) & _MF) * _ONES  # byte k: set bits of bytes 0 to k
    r = r.astype(_u64)
    shift = (_8 - np.bitwise_count(((s | _TOPS) - (r + _1) * _ONES) & _TOPS)) * _8
    before = ((s << _8) >> shift) & _u64(0xFF)
    return shift.astype(np.int64) + _PLACE[((word >> shift) & _u64(0xFF)).astype(np.intp), (r - before).astype(np.intp)]


def _zeros_below(word: np.ndarray) -> np.ndarray:
    """Number of zero bits below the lowest set bit (64 where there is none)."""
    return np.bitwise_count((word & (_u64(0) - word)) - _1).astype(np.int64)


#: values packed at once: a multiple of 64, so that each block fills whole words
_BLOCK = 1 << 16


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, back to back, in 64-bit words (one spare word at the end)."""
    words = np.zeros(len(values) * width // 64 + 2, _u64)
    mask = _u64((1 << width) - 1)
    for i in range(0, len(values) if width else 0, _BLOCK):
        v = values[i : i + _BLOCK].astype(_u64) & mask
        at = np.arange(len(v), dtype=np.int64) * width
        shift = (at & 63).astype(_u64)
        word = at >> 6
        part = words[i * width // 64 :]
        # values share words only with their neighbours: one sum per word
        first = np.flatnonzero(np.diff(word, prepend=-1))
        part[word[first]] |= np.add.reduceat(v << shift, first)
        spill = np.flatnonzero(shift.astype(np.int64) + width > 64)
        part[word[spill] + 1] |= v[spill] >> (_64 - shift[spill])
    return words


def _unpack(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), _u64)
    at = index * width
    word, shift = at >> 6, (at & 63).astype(_u64)
    # the part of the next word, moved in two steps because a shift by 64 is none
    return ((words[word] >> shift) | ((words[word + 1] << _1) << (_63 - shift))) & _u64((1 << width) - 1)


def build(values: np.ndarray) -> dict[str, np.ndarray]:
    """Parts of the sequence of non-decreasing ``values``."""
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    size = ((top - 1) >> width if n else 0) + n + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    for i in range(0, n, _BLOCK):
        v = values[i : i + _BLOCK].astype(_u64)
        bits[(v >> _u64(width)).astype(np.int64) + np.arange(i, i + len(v))] = 1
    words = np.packbits(bits, bitorder="little").view(_u64)
    rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    return {"shape": np.array([n, width], np.int64), "low": _pack(values, width), "high": words, "rank": rank}


class EliasFano:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in parts["shape"])
        self.low, self.high, self.rank = parts["low"], parts["high"], parts["rank"]
        self._zeros = None

    def _place(self, index: np.ndarray) -> np.ndarray:
        """Place in the high bits of the index-th value."""
        w = np.searchsorted(self.rank, index, "right") - 1
        return 64 * w + _select(self.high[w], index - self.rank[w])

    def _window(self, at: np.ndarray) -> np.ndarray:
        """The 64 high bits from each place on.  The sequence ends in zeros, so what stands beyond is never looked at."""
        last = len(self.high) - 1
        at = np.minimum(at, 64 * last + 63)
        w, shift = at >> 6, (at & 63).astype(_u64)
        return (self.high[w] >> shift) | ((self.high[np.minimum(w + 1, last)] << _1) << (_63 - shift))

    def _value(self, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((at - index).astype(_u64) << _u64(self.width)) | _unpack(self.low, index, self.width)

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at ``index``."""
        index = np.asarray(index, np.int64)
        return self._value(index, self._place(index))

    def get_two(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at ``index`` and at ``index + 1``."""
        index = np.asarray(index, np.int64)
        at = self._place(index)
        gap = _zeros_below(self._window(at + 1))
        after = at + 1 + gap
        far = np.flatnonzero(gap == 64)
        if len(far):
            after[far] = self._place(index[far] + 1)
        return self._value(index, at), self._value(index + 1, after)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        index = np.arange(self.n)
        at = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        return self._value(index, at)

    def _first(self, h: np.ndarray) -> np.ndarray:
        """First index whose high part is at least ``h``: the place after the h-th zero, less the zeros before it."""
        if self._zeros is None:
            self._zeros = 64 * np.arange(len(self.rank), dtype=np.int64) - self.rank
        top = int(self._zeros[-1])
        low, high = (int(h.min()), int(h.max())) if len(h) else (1, 1)
        r = (h if low > 0 and high <= top else np.clip(h, 1, top)) - 1
        w = np.searchsorted(self._zeros, r, "right") - 1
        first = 64 * w + _select(~self.high[w], r - self._zeros[w]) - r
        if low <= 0:
            first = np.where(h <= 0, 0, first)
        if high > top:
            first = np.where(h > top, self.n, first)
        return np.minimum(first, self.n)

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First index whose high part is at least ``h``, and the number of values with that high part."""
        first = self._first(h)
        run = _zeros_below(~self._window(first + h))
        far = np.flatnonzero(run == 64)
        if len(far):  # the run goes on: up to the next zero
            run[far] = self._first(h[far] + 1) - first[far]
        return first, np.minimum(run, self.n - first)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.asarray(x, _u64)
        h = np.minimum(x >> _u64(self.width), _u64((1 << 62) - 1)).astype(np.int64)
        lo, run = self._bucket(h)
        hi = lo + run
        want, end = x & _u64((1 << self.width) - 1), hi.copy()
        # the values of one high part are few: binary search between the bounds
        live = np.flatnonzero(run > 0)
        l, r, x = lo[live], hi[live], want[live]
        while len(live):
            mid = (l + r) >> 1
            less = _unpack(self.low, mid, self.width) < x
            l, r = np.where(less, mid + 1, l), np.where(less, r, mid)
            lo[live] = l
            more = l < r
            live, l, r, x = (v.compress(more) for v in (live, l, r, x))
        return lo, end, want

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value at least ``x`` (n where there is none)."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of ``x``, by its successor; -1 where that is another value."""
        at, end, want = self._search(x)
        hit = np.flatnonzero(at < end)
        out = np.full(len(at), -1, np.int64)
        same = _unpack(self.low, at[hit], self.width) == want[hit]
        hit = hit.compress(same)
        out[hit] = at[hit]
        return out
