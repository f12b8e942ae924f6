"""Byte-level text primitives on Arrow buffers: word spans and 64-bit word hashes.

All word classes used by the operators are unions of ASCII bytes and every
non-ASCII character, so they can be decided byte by byte on UTF-8 without
decoding.  Everything here is vectorised over a chunk of whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: text worked on at once: bounds the memory of a worker (a longer text is a chunk of its own)
CHUNK_BYTES = 2 << 20

_u64 = np.uint64


def _word_table(breaks: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, bool)
    for lo, hi in breaks:
        t[lo : hi + 1] = False
    return t


#: ``[^\x20\x09-\x0D]+``
SPACED = _word_table([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = _word_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = np.asarray(x, _u64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _u64(30))) * _u64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _u64(27))) * _u64(0x94D049BB133111EB)
    return x ^ (x >> _u64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit constants."""
    return mix((np.arange(1, n + 1, dtype=_u64) + _u64(salt * 1_000_003)) * _u64(0x9E3779B97F4A7C15))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LENGTH = seeds(33, 1)
#: the low 0 to 8 bytes of a word
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _u64)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a column into runs of whole rows of about ``limit`` bytes: (first, end, bytes, offsets)."""
    data, off = flat(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and, per row, the range of its words (``rows[i]:rows[i+1]``)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    if fold:
        table = table.copy()
        table[65:91] = table[97:123]
    w = table[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    gap = np.empty(n, bool)
    gap[0] = True
    np.logical_not(w[:-1], out=gap[1:])
    gap |= edge[:n]
    start = np.flatnonzero(w & gap)
    gap[-1] = True
    np.logical_not(w[1:], out=gap[:-1])
    gap |= edge[1:]
    end = np.flatnonzero(w & gap) + 1
    return start, end, np.searchsorted(start, off)


def ranks(head: np.ndarray) -> np.ndarray:
    """Number of the group of each element, where ``head`` marks the first of each (32 bits: much the fastest sum)."""
    return np.cumsum(head.view(np.int8), dtype=np.int32 if len(head) < 1 << 31 else np.int64) - 1


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct values, first place of each, index of each element's value)."""
    bits = _u64(len(h).bit_length())
    # the high bits with the place below them sort in one word, faster than an index does
    word = (h >> bits << bits) | np.arange(len(h), dtype=_u64)
    word.sort()
    order = (word & ((_u64(1) << bits) - _u64(1))).view(np.int64)
    ranked = h[order]
    if (ranked[1:] < ranked[:-1]).any():  # values that differ in the low bits only
        order = np.argsort(h, kind="stable")
        ranked = h[order]
    head = np.ones(len(h), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=head[1:])
    back = np.empty(len(h), np.int64)
    back[order] = ranks(head)
    return ranked.compress(head), order.compress(head), back


def blocks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of ``data`` on as a little-endian number (zeros beyond the end), without copying each."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each span; with ``fold`` A-Z hash as a-z.

    Spans of up to 7 bytes all differ.  Longer ones are mixed 8 bytes at a time, and from 33 bytes on
    they take BLAKE2b, so no family of texts collides by its algebra."""
    size = end - start
    if not len(size):
        return np.zeros(0, _u64)
    if fold:
        data = _FOLD[data]
    view = blocks(data)
    short = size < 8
    h = view[start] & _MASK[np.minimum(size, 8)]
    h = mix(np.where(short, h | (size.astype(_u64) << _u64(56)), h ^ _LENGTH[np.minimum(size, 32)]))
    live, at = np.flatnonzero((size > 8) & (size <= 32)), 8
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live] * _u64(0x9E3779B97F4A7C15) ^ (view[start[live] + at] & _MASK[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for k in np.flatnonzero(size > 32).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return h
