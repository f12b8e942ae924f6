"""Session plumbing shared by the corpus operators.

Intermediate tables are written to the folder the cluster names in
``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor
never costs more than the tasks it was running.
"""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: rows that travel to a Python worker at once, where the session has not set another number
BATCH_ROWS = 1_000

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: whether Parquet reads whole column chunks at once: on a file system of the machine each chunk then passes through a
#: buffer outside the heap, which its thread keeps
_VECTORED = "parquet.hadoop.vectored.io.enabled"
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; a temporary one only for a single-machine session."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = spark.conf.get("gridloom.local.checkpoint.dir", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
            spark.conf.set("gridloom.local.checkpoint.dir", folder)
    path, conf = _path(spark, folder)
    return path.getFileSystem(conf).makeQualified(path).toString().rstrip("/")


def _path(spark: SparkSession, uri: str):
    sc = spark.sparkContext
    return sc._jvm.org.apache.hadoop.fs.Path(uri), sc._jsc.hadoopConfiguration()


_noted: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in this application's own part."""
    path = f"{shared_dir(spark)}/gridloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    for paths in _noted:
        paths.append(path)
    return path


@contextlib.contextmanager
def noted():
    """The paths that are handed out meanwhile."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def discard(spark: SparkSession, uri: str) -> None:
    path, conf = _path(spark, uri)
    path.getFileSystem(conf).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete everything this application has stored; results that were not yet written are lost with it."""
    path, conf = _path(spark, f"{shared_dir(spark)}/gridloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files behind a materialised table that no later plan reads."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/gridloom/" in parent:
            discard(df.sparkSession, parent)


def open_shared(uri: str):
    """(file system, path) of a file in the shared folder, for a worker."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def mapped(uri: str):
    """Bytes of a shared file, and how many of them are held in memory: none where the folder is mounted, as the file
    is mapped then, else all."""
    import numpy as np
    from pyarrow import fs

    fs_, path = open_shared(uri)
    if isinstance(fs_, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r").view(np.ndarray), 0
    with fs_.open_input_file(path) as f:
        raw = np.frombuffer(f.read(), np.uint8)
    return raw, len(raw)


def released(run):
    """``run``, an iterator function of a Python worker, with its freed memory handed back to the system at its end:
    workers live on from stage to stage."""

    @functools.wraps(run)
    def wrapped(*args):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they start."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":  # the default: many long texts at once would fill a worker
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if spark.conf.get(_VECTORED, None) is None and sc._jsc.hadoopConfiguration().get(_VECTORED) is None:
        spark.conf.set(_VECTORED, "false")
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    fd, archive = tempfile.mkstemp(prefix="gridloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "gridloom")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
