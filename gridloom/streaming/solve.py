"""Solving fields that arrive as a stream (an extension): each micro-batch holds whole right-hand
sides, told apart by ``rhs_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.solver import FieldSolver


def solve_stream(fields: DataFrame, solver: FieldSolver, path: str, checkpoint: str):
    """Start a query that appends the solution of every micro-batch to a Parquet folder.  Solutions are
    keyed by batch, so a replayed batch replaces what it wrote before."""

    def each(batch: DataFrame, batch_id: int) -> None:
        solver.solve(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return fields.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
