"""FieldSolver: plan once, solve many fields lazily."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import blocks, dense, multiply, transform
from gridloom.operators.layout import AXES, FIELD, checked, normalise
from gridloom.plans.spec import Diff, Equation, GridSpec, Kernel
from gridloom.sources.library import GreenLibrary

#: points (times components) that one task solves at once
LOCAL_POINTS = 1 << 22
#: points of a plane that one task transforms at once
SLAB_POINTS = 1 << 20


class FieldSolver:
    """Poisson solver for fields in DataFrames (``[rhs_id,] [comp,] i0, i1, i2, v``).

    ``strategy``: "local" solves each ``rhs_id`` in one task (one exchange), "slab" and "pencil"
    distribute a single field; "auto" picks by the grid's size.  Use as a context manager, or call
    ``close``, to release the cached Green's table; with ``keep_green`` off none is cached.  With a ``library`` the
    table of a solve in blocks is read from it, and stored there first if need be."""

    def __init__(self, spark: SparkSession, grid: GridSpec, kernel: Kernel = Kernel.CHAT_2, equation: Equation = Equation.STD, diff: Diff = Diff.NOD, alpha: float = 2.0, strategy: str = "auto", keep_green: bool = True, library: GreenLibrary | None = None):
        if equation == Equation.ROT and (grid.components != 3 or diff == Diff.NOD):
            raise ValueError("the rotational equation needs three components and a derivative")
        self.spark, self.grid, self.kernel, self.equation, self.diff, self.alpha = spark, grid, Kernel(kernel), equation, diff, alpha
        if strategy == "auto":
            padded = int(np.prod(grid.modes)) * grid.components
            a, b = (grid.modes[d] for d in grid.order[:2])
            strategy = "local" if padded <= LOCAL_POINTS else "slab" if a * b <= SLAB_POINTS else "pencil"
        if strategy not in ("local", "slab", "pencil"):
            raise ValueError(f"unknown strategy {strategy}")
        self.strategy, self.keep_green, self.library = strategy, keep_green, library
        self._green: DataFrame | None = None
        self._octant: DataFrame | None = None

    def __enter__(self) -> FieldSolver:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for table in (self._green, self._octant):
            if table is not None:
                table.unpersist()
        self._green = self._octant = None

    def spectral_info(self) -> dict[str, tuple]:
        return self.grid.spectral_info()

    def green(self) -> DataFrame:
        """Green's table on the spectral grid, computed once and reused by later solves (unless ``keep_green`` is off)."""
        if not self.keep_green:
            return multiply.green_table(self.spark, self.grid, self.kernel, self.alpha)
        if self._green is None:
            self._green = multiply.green_table(self.spark, self.grid, self.kernel, self.alpha).persist()
        return self._green

    # the stages, for users who put work between them

    def forward(self, field: DataFrame) -> DataFrame:
        """Spectrum of a field, or of lines gathered along the first axis of the grid's order (strategy "pencil")."""
        if "pts" in field.columns:
            if self.strategy != "pencil":
                raise ValueError("gathered lines are transformed as pencils")
            return transform.forward(self.grid, field)
        return transform.forward(self.grid, normalise(field), self.strategy != "pencil")

    def multiply(self, spectrum: DataFrame) -> DataFrame:
        if self.equation == Equation.ROT:
            spectrum = multiply.curl(spectrum, self.grid, self.diff)
        return multiply.multiply(spectrum, self.grid, self.kernel, self.alpha, self.green() if self.grid.unbounded else None)

    def apply_spectral(self, spectrum: DataFrame, f) -> DataFrame:
        return multiply.apply_spectral(spectrum, self.grid, f)

    def backward(self, spectrum: DataFrame) -> DataFrame:
        out = transform.backward(self.grid, spectrum, self.strategy != "pencil", self.equation == Equation.ROT)
        return out.select("rhs_id", "comp", *AXES, F.col("re").alias("v"))

    def octant(self) -> DataFrame | None:
        """The folded Green's table of a solve in blocks, kept like ``green`` or in the library; None where no table is needed."""
        if self.library is not None:
            return self.library.octant(self.grid, self.kernel, self.alpha, self.strategy == "slab")
        make = lambda: blocks.green_blocks(self.spark, self.grid, self.kernel, self.alpha, self.strategy == "slab")
        if not self.keep_green:
            return make()
        if self._octant is None and (table := make()) is not None:
            self._octant = table.persist()
        return self._octant

    def solve(self, field: DataFrame, spectral=None, check: bool = False) -> DataFrame:
        """Solution field; ``spectral(k0, k1, k2, re, im)`` may filter it in wave space (not with "local"); ``check``
        makes the job fail on a value that is not a number.  "slab" and "pencil" move blocks (``blocks.solve``), and a
        field of blocks is solved in blocks; with a filter, or with lines as in ``forward``, they move rows."""
        lines = "pts" in field.columns
        if check and not lines and "values" not in field.columns:
            field = checked(field)
        if self.strategy == "local" and spectral is None:
            return self._local(field)
        if spectral is None and not lines:
            return blocks.solve(self.grid, field, self.kernel, self.equation, self.diff, self.alpha, self.strategy == "slab", self.octant())
        y = self.multiply(self.forward(field))
        return self.backward(y if spectral is None else self.apply_spectral(y, spectral))

    def _local(self, field: DataFrame) -> DataFrame:
        grid, kernel, equation, diff, alpha = self.grid, self.kernel, self.equation, self.diff, self.alpha

        def run(key, table):
            f = np.zeros((grid.components, *grid.shape))
            f[tuple(np.asarray(table.column(c)) for c in ("comp", *AXES))] = np.asarray(table.column("re"))
            u = dense.solve(grid, f, kernel, equation, diff, alpha)
            c, i, j, k = (x.ravel().astype(np.int32) for x in np.indices(u.shape))
            return pa.table({"rhs_id": np.full(u.size, key[0].as_py(), np.int64), "comp": c, "i0": i, "i1": j, "i2": k, "v": u.ravel()})

        return normalise(field).groupBy("rhs_id").applyInArrow(run, FIELD)
