"""Raw files of fields as a Spark data source: read in byte ranges by many tasks, written in parts by many tasks.

A file holds values of one type, first axis fastest, nothing else.  A written field is a folder of such files, each with
some whole planes of the last axis, and ``field.json`` with the size, the type and the first plane of each part; spectra
have files of real and of imaginary parts.  Parts are written beside their names and moved there by the driver once all
are complete, so a lost task or a second attempt leaves nothing that a reader would see.

``register(spark)`` once, then ``spark.read.format("gridraw").option("shape", "128,128,128").load(path)``; ``write``
deals a field out into parts and stores it."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.operators.layout import AXES, FIELD, SPECTRUM

NAME = "gridraw"
#: bytes that a task reads, and that a part holds
SPLIT_BYTES = 32 << 20
#: rows of a batch
BATCH = 1 << 17
_KEYS = [("rhs_id", pa.int64()), ("comp", pa.int32()), *((a, pa.int32()) for a in AXES)]


def _open(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _exists(path: str) -> bool:
    from pyarrow import fs

    where, inner = _open(path)
    return where.get_file_info(inner).type != fs.FileType.NotFound


def _header(path: str) -> dict | None:
    name = f"{path.rstrip('/')}/field.json"
    if not _exists(name):
        return None
    where, inner = _open(name)
    with where.open_input_stream(inner) as f:
        return json.loads(f.read())


@dataclass
class Range(InputPartition):
    """Values ``first`` to ``first + count`` of a field, at ``offset`` bytes of each of its files."""

    files: tuple[str, ...]
    offset: int
    first: int
    count: int


class RawReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.header = _header(path) or {"shape": [int(x) for x in options["shape"].split(",")], "dtype": options.get("dtype", "<f8"), "columns": ["v"], "parts": [{"files": [path], "plane": 0}]}
        self.path, self.split = path, int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        n0, n1, n2 = self.header["shape"]
        size, out = np.dtype(self.header["dtype"]).itemsize, []
        step = max(1, self.split // size)
        ends = [p["plane"] for p in self.header["parts"][1:]] + [n2]
        for part, end in zip(self.header["parts"], ends):
            files = tuple(f if "/" in f else f"{self.path.rstrip('/')}/{f}" for f in part["files"])
            first, count = part["plane"] * n0 * n1, (end - part["plane"]) * n0 * n1
            for f in files:
                where, inner = _open(f)
                if (have := where.get_file_info(inner).size) != count * size:
                    raise ValueError(f"{f} holds {have} bytes, not {count * size}")
            out += [Range(files, at * size, first + at, min(step, count - at)) for at in range(0, count, step)]
        return out or [Range((), 0, 0, 0)]

    def read(self, partition: Range):
        n0, n1, _ = self.header["shape"]
        kind = np.dtype(self.header["dtype"])
        columns = []
        for f in partition.files:
            where, inner = _open(f)
            with where.open_input_file(inner) as source:
                columns.append(np.frombuffer(source.read_at(partition.count * kind.itemsize, partition.offset), kind))
        for at in range(0, partition.count, BATCH):
            i = np.arange(partition.first + at, partition.first + min(at + BATCH, partition.count))
            keys = [np.zeros(len(i)), np.zeros(len(i)), i % n0, i // n0 % n1, i // (n0 * n1)]
            cols = [pa.array(k.astype(t.to_pandas_dtype())) for k, (_, t) in zip(keys, _KEYS)] + [pa.array(c[at : at + len(i)].astype(float)) for c in columns]
            yield pa.RecordBatch.from_arrays(cols, names=[*(k for k, _ in _KEYS), *self.header["columns"]])


@dataclass
class Written(WriterCommitMessage):
    """Files of the parts of one task: (plane, names as they are now, names as they shall be)."""

    parts: list


class RawWriter(DataSourceArrowWriter):
    """Parts of rows that are sorted by part, as ``write`` deals them."""

    def __init__(self, path: str, options: dict, columns: list[str]):
        self.path, self.columns = path.rstrip("/"), columns
        self.shape, self.planes = [int(x) for x in options["shape"].split(",")], int(options["planes"])
        self.kind = np.dtype(options.get("dtype", "<f8"))
        self.run = uuid.uuid4().hex

    def _store(self, part: int, values: list[np.ndarray]) -> tuple:
        attempt, now, then = uuid.uuid4().hex, [], []
        for c, v in zip(self.columns, values):
            name = f"part-{part:06d}" + ("" if len(self.columns) == 1 else {"re": "_real", "im": "_imag"}[c])
            where, inner = _open(f"{self.path}/_{self.run}/{name}-{attempt}")
            where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with where.open_output_stream(inner) as out:
                out.write(v.tobytes())
            now.append(f"_{self.run}/{name}-{attempt}")
            then.append(name)
        return part * self.planes, now, then

    def write(self, iterator) -> Written:
        n0, n1, n2 = self.shape
        out, part, values = [], None, []
        for b in iterator:
            at = [np.asarray(b.column(a)).astype(np.int64) for a in AXES]
            of = at[2] // self.planes
            for p in np.unique(of).tolist():
                if p != part:
                    if part is not None:
                        out.append(self._store(part, values))
                    part, size = p, n0 * n1 * (min((p + 1) * self.planes, n2) - p * self.planes)
                    values = [np.zeros(size, self.kind) for _ in self.columns]  # points that the field lacks stay 0
                mine = of == p
                place = at[0][mine] + n0 * (at[1][mine] + n1 * (at[2][mine] - p * self.planes))
                for c, v in zip(self.columns, values):
                    v[place] = np.asarray(b.column(c))[mine]
        if part is not None:
            out.append(self._store(part, values))
        return Written(out)

    def commit(self, messages) -> None:
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        planes = list(range(0, self.shape[2], self.planes))
        if [p[0] for p in parts] != planes:
            raise ValueError(f"parts of planes {[p[0] for p in parts]}, not {planes}")
        where, inner = _open(self.path)
        for _, now, then in parts:
            for a, b in zip(now, then):
                where.move(f"{inner}/{a}", f"{inner}/{b}")
        head = {"shape": self.shape, "dtype": self.kind.str, "columns": self.columns, "parts": [{"plane": p, "files": then} for p, _, then in parts]}
        with where.open_output_stream(f"{inner}/field.json") as f:
            f.write(json.dumps(head).encode())
        self.abort(messages)

    def abort(self, messages) -> None:
        """Remove what attempts have left."""
        if _exists(f"{self.path}/_{self.run}"):
            where, inner = _open(f"{self.path}/_{self.run}")
            where.delete_dir(inner)


class RawFields(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        head = _header(self.options["path"])
        return SPECTRUM if head and len(head["columns"]) == 2 else FIELD

    def reader(self, schema) -> RawReader:
        return RawReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> RawWriter:
        if _header(self.options["path"]) and not overwrite:
            raise ValueError(f"{self.options['path']} holds a field")
        return RawWriter(self.options["path"], dict(self.options), [c for c in ("v", "re", "im") if c in schema.names])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawFields)


def read(spark: SparkSession, path: str, shape: tuple[int, int, int] | None = None, dtype: str = "<f8", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A raw file of this shape, or a folder that ``write`` has left, as a field or a spectrum."""
    register(spark)
    options = {"splitBytes": str(split_bytes), "dtype": dtype} | ({"shape": ",".join(map(str, shape))} if shape else {})
    return spark.read.format(NAME).options(**options).load(path)


def write(df: DataFrame, path: str, shape: tuple[int, int, int], single: bool = False, part_bytes: int = SPLIT_BYTES) -> None:
    """Store one component of a field or spectrum; ``single`` stores 32-bit values.  A part is some whole planes of about
    ``part_bytes``, put together by one task; points that the field lacks are 0."""
    spark = df.sparkSession
    register(spark)
    kind, columns = ("<f4" if single else "<f8"), [c for c in ("v", "re", "im") if c in df.columns]
    planes = max(1, min(shape[2], part_bytes // (shape[0] * shape[1] * np.dtype(kind).itemsize)))
    # every part has a row, so that planes without points are written too
    marks = spark.range(math.ceil(shape[2] / planes)).select(F.lit(0).alias("i0"), F.lit(0).alias("i1"), (F.col("id") * planes).cast("int").alias("i2"), *(F.lit(None).cast("double").alias(c) for c in columns))
    rows = df.select(*(F.col(a).cast("int").alias(a) for a in AXES), *(F.col(c).cast("double").alias(c) for c in columns)).unionByName(marks)
    rows = rows.groupBy(*AXES).agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in columns))
    part = F.floor(F.col("i2") / planes)
    rows = rows.withColumn("part", part).repartition("part").sortWithinPartitions("part", *reversed(AXES)).drop("part")
    rows.write.format(NAME).mode("append").options(shape=",".join(map(str, shape)), planes=str(planes), dtype=kind).save(path)
