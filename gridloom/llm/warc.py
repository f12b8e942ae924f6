"""WARC archives with revisit resolution.

Each partition first lays its payloads, compressed, into segment files of the shared folder and hands on headers
only: page, url, digest, length and place.  Headers are shuffled by payload digest to find each payload's original
(the smallest page_id) and joined to it, then brought together by segment; a task reads its segments and writes
archives of gzip-member records with fresh headers, originals with their payload, revisits without.  Bodies are
never shuffled.  Archives are rows (archive, content) of a Parquet table in the shared folder, so a write is
whole or absent; ``export`` streams them out as plain ``.warc.gz`` files.  A segment has a name of its own for each
attempt to write it, so a lost executor or a second attempt never changes what the headers point to.

Defined results
---------------
* The payload is the html in UTF-8; null reads as empty.  Payloads under 100 bytes are never revisits.
* Rows that repeat the smallest page_id of a payload are all responses.  A null page_id is written without an id
  and reads back as null; it is a revisit if the same payload has a page with an id, else a response.
* A null url is written as an empty target.  An empty table writes no archive.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.runtime import materialise, mapped, open_shared, released, scratch

SMALLEST_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
#: payloads of a segment, compressed, and what is taken of an archive at once
SEGMENT_BYTES = 4 << 20
READ_BYTES = 16 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _stage(folder: str):
    """Payloads into segment files; headers out."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        name, out, at = None, None, 0
        for batch in batches:
            data, off = W.flat(batch.column("html"))
            raw, places = memoryview(data), off.tolist()
            cols = {k: [] for k in ("payload_digest", "segment", "at", "size")}
            for i, j in zip(places, places[1:]):
                if out is None:
                    name, at = f"{folder}/{uuid.uuid4().hex}.seg", 0
                    fs, path = open_shared(name)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(path)
                blob = press.compress(raw[i:j])
                out.write(blob)
                for k, v in zip(cols, (hashlib.sha256(raw[i:j]).hexdigest(), name, at, len(blob))):
                    cols[k].append(v)
                at += len(blob)
                if at >= SEGMENT_BYTES:
                    out.close()
                    out = None
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(np.diff(off)), pa.array(cols["payload_digest"], pa.string())]
            arrays += [pa.array(cols["segment"], pa.string()), pa.array(cols["at"], pa.int64()), pa.array(cols["size"], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "payload_bytes", "payload_digest", "segment", "at", "size"])
        if out is not None:
            out.close()

    return stage


def stage(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest and the place (segment, at, size) of each row's payload, as stored."""
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, payload_bytes long, payload_digest string, segment string, at long, size long"
    rows = pages.select("page_id", "url", "html").mapInArrow(released(_stage(scratch(pages.sparkSession, "payloads"))), schema)
    return materialise(rows, "headers")


def resolve(heads: DataFrame) -> DataFrame:
    """``heads`` and a column ``original``, null unless the row is a revisit."""
    several = heads.where(F.col("payload_bytes") >= SMALLEST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # stored before it is joined: a join of two plain exchanges can be split where one payload has most rows
    several = materialise(several.where("_n > 1"), "originals")
    joined = heads.join(several.withColumnRenamed("payload_digest", "_d"), F.col("payload_digest") == F.col("_d"), "left")
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.withColumn("original", F.when(revisit, F.col("_first"))).drop("_d", "_n", "_first")


def _record(kind: str, page: str | None, url: str, digest: str, size: int, block: bytes, refers: str | None, date: str) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}:{digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if page is None else [f"X-Page-ID: {_line(page)}"]),
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response:{refers}:{digest}')}>", f"X-Refers-To-Page: {_line(refers)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _line(value: str) -> str:
    """A header value on one line; ``_unline`` undoes it."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str | None) -> str | None:
    return None if value is None else value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _target(url: str | None) -> str:
    """A url as a target; one with a line break cannot stand in a header as it is."""
    return "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def _writer(date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0
        expand, name, segment = zstandard.ZstdDecompressor(), None, None

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{serial:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for row in batch.to_pylist():
                n, first = row["payload_bytes"], row["original"]
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
                if first is None:
                    if row["segment"] != name:
                        name = row["segment"]
                        segment = mapped(name)[0]
                    block += expand.decompress(segment[row["at"] : row["at"] + row["size"]], max_output_size=n)
                page = None if row["page_id"] is None else str(row["page_id"])
                kind, refers = ("response", None) if first is None else ("revisit", str(first))
                held.append(_record(kind, page, _target(row["url"]), row["payload_digest"], n, block, refers, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield emit()
                    serial, held, size = serial + 1, [], 0
        if held:
            yield emit()

    return write


def write_archives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Write deduplicated archives of ``pages(page_id, url, html)``; returns the stored (archive, content) table."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = resolve(stage(pages)).repartition(parts, "segment").sortWithinPartitions("segment", "at")
    return materialise(rows.mapInArrow(released(_writer(date)), "archive string, content binary"), "warc")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + READ_BYTES]
            if not piece:
                raise ValueError("truncated archive")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(headers["Content-Length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError("bad record length")
        yield headers, rest[:n]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            out = {"page": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers": []}
            for head, block in records(content.as_py()):
                kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError("payload does not match its digest")
                out["page"].append(_unline(head.get("X-Page-ID")))
                out["payload_bytes"].append(size)
                out["payload_digest"].append(digest)
                out["record_type"].append(kind)
                out["refers"].append(_unline(head.get("X-Refers-To-Page")))
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string())])
            )


def read_archives(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    rows = archives.select("content").mapInArrow(released(_reader), "page string, payload_bytes long, payload_digest string, record_type string, refers string")
    return rows.select(F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"))


def export(archives: DataFrame, folder: str) -> int:
    """Stream the stored archives, one at a time, to files in ``folder`` (any Hadoop path); returns their number."""
    spark = archives.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for row in archives.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row['archive']}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(row["content"]))
        out.close()
        n += 1
    return n


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages), pages.schema["page_id"].dataType.simpleString())


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f ON p.d = f.d
"""
