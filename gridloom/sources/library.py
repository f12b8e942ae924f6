"""Green's tables on shared storage: made once, found again by later sessions.

A table is a folder named by what it depends on: grid, kernel, length and tiles.  It is written beside its name and
renamed when it is complete, so readers never see half a table, two sessions that make the same one do no harm, and a
lost executor costs no more than a read."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import blocks
from gridloom.plans.spec import GridSpec, Kernel


class GreenLibrary:
    """Stored tables below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def name(self, grid: GridSpec, kernel: Kernel, alpha: float, slabs: bool) -> str:
        sides = [[(int(a.left), int(a.right), a.n, a.length) for a in grid.axes], int(grid.center)]
        text = repr((sides, Kernel(kernel).name, float(alpha), bool(slabs), blocks.BlockPlan(grid, slabs).size))
        return f"{Kernel(kernel).name.lower()}-{hashlib.sha256(text.encode()).hexdigest()[:24]}"

    def octant(self, grid: GridSpec, kernel: Kernel, alpha: float = 2.0, slabs: bool = False) -> DataFrame | None:
        """The folded table of this problem, stored first where it is not there yet; None where no table is needed."""
        uri = f"{self.path}/{self.name(grid, kernel, alpha, slabs)}"
        fs, path = self._fs(uri)
        if not fs.exists(path):
            made = blocks.green_blocks(self.spark, grid, kernel, alpha, slabs)
            if made is None:
                return None
            part = f"{self.path}/_{uuid.uuid4().hex}"
            made.write.parquet(part)
            _, here = self._fs(part)
            if fs.exists(path) or not fs.rename(here, path):  # another session was first
                fs.delete(here, True)
        return self.spark.read.schema(blocks.BLOCK).parquet(uri)
