"""Packing of tokenised documents into training sequences: bounded-space online best fit.

Documents are encoded and cut where they are read.  A piece that fills a sequence takes one of its own at once; the
others, a few dozen bytes each, are dealt to as few tasks as hold ``TASK_PIECES`` each, arrive there longest first,
and go into the fullest open bin that has room.  The open bins are stacks by free space and one integer whose bits say
which stacks are not empty, so the best fit is the lowest bit from the piece's size on.  No more than ``OPEN_BINS``
are open; before one more is opened the fullest closes.  A bin is only a number and a fill, as each piece is placed
for good when it arrives.  Falling lengths waste 0.02 % of the places on the driver's documents where a random order
wastes 2 %, but only while the bins stay open, which is why there are more of them than pieces in a task.

Defined results
---------------
* A document is its ids and the end id; null and empty texts are just the end id.  Special-token strings inside a text
  become the vocabulary's added tokens.
* Only documents longer than a sequence are cut, into full pieces; the first piece takes the remainder.
* Rows that repeat a ``doc_id``, equal or not, are documents of their own; a null ``doc_id`` is carried along.
* Sequence numbers are unique, not dense; places in a sequence have no gaps.  Reruns on the same partitions agree.
* An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.runtime import materialise, released
from gridloom.llm.token_ids import CHUNK_BYTES, VOCABULARY, Encoder

CAPACITY = 1024
END_ID = 2
#: bins that a task holds open
OPEN_BINS = 1 << 18
#: pieces that a task packs, when there are enough
TASK_PIECES = 1 << 17

_PIECE = "piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, Encoder] = {}


class Bins:
    """Open bins by free space."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.made = self.open = 0
        self._stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._free = 0  # bit f: some open bin has f places free

    def _take(self, free: int) -> int:
        stack = self._stacks[free]
        b = stack.pop()
        if not stack:
            self._free ^= 1 << free
        self.open -= 1
        return b

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``capacity`` tokens."""
        fits = self._free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self._free & -self._free).bit_length() - 1)
            b, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            if not self._stacks[left]:
                self._free ^= 1 << left
            self._stacks[left].append(b)
            self.open += 1
        return b, self.capacity - free


def cut(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) of the pieces of documents of ``counts`` tokens, in order."""
    pieces = -(-counts // capacity)
    row = np.repeat(np.arange(len(counts)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = counts - capacity * (pieces - 1)
    length = np.where(piece == 0, first[row], capacity)
    start = np.where(piece == 0, 0, first[row] + capacity * (piece - 1))
    return row, piece, start, length


def _cutter(path: str | None, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

            file = public_tokenizers.path(VOCABULARY)
        else:
            file = path
        encoder = _encoders.get(file) or _encoders.setdefault(file, Encoder(file))
        for batch in batches:
            for i, j, _, _ in W.chunks(batch.column("text"), CHUNK_BYTES):
                ids, counts = encoder.encode(batch.column("text").slice(i, j - i))
                ends = np.cumsum(counts)
                ids[ends - 1] = end_id
                row, piece, start, length = cut(counts, capacity)
                at = (ends - counts)[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                cols = [batch.column("doc_id").slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:  # the pieces of all documents are the ids in order
                    bounds = np.append(at, len(ids)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of the pieces of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_PIECE}" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(released(_cutter(vocabulary, capacity, end_id, with_ids)), schema)


def _packer(capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(capacity, limit), TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            b, offset = np.array(places, np.int64).T
            # even numbers: bins
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((base + b) * 2), pa.array(np.ascontiguousarray(offset))], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(table: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Pieces (``length`` from 1 to ``capacity``, other columns at will) with their ``sequence_id`` and ``offset``.
    The table is read twice, so it should be a stored one."""
    full = table.where(F.col("length") == capacity)
    full = full.withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    rest = table.where(F.col("length") < capacity)
    tasks = max(1, -(-rest.count() // task_pieces))
    # bins gain from many pieces in a task, so there are as few tasks as may be
    rest = rest.repartition(tasks).sortWithinPartitions(F.desc("length"), *(c for c in ("doc_id", "piece", "ids_crc32") if c in table.columns))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields) + ", sequence_id long, offset long"
    return full.unionByName(rest.mapInArrow(_packer(capacity, open_bins), schema))


def sequences(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Training sequences: sequence_id, ids, and the doc_ids and lengths of the pieces in their order."""
    packed = pack(materialise(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
    # at most ``capacity`` pieces, of ``capacity`` ids in all
    gathered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("x"))
    return gathered.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.length").alias("lengths"))


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(materialise(pieces(docs, with_ids=False), "pieces"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
