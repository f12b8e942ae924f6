"""What a solve costs: rows, bytes and seconds by step of a run, seconds by stage, and the exchanges of a plan."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame


def exchanges(df: DataFrame) -> list[str]:
    """The shuffles and broadcasts of a DataFrame's plan, from the result down, as their partitionings."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"(?:Broadcast)?Exchange (?:\w+\(.*?\)|\w+)(?=,|\n|$)", plan)]


#: what operators count: rows, bytes, milliseconds (names of Spark's metrics)
_ROWS = ("shuffleRecordsWritten", "pythonNumRowsReceived", "numOutputRows")
_BYTES = ("shuffleBytesWritten", "pythonDataReceived", "filesSize")
_DATA = ("dataSize", "pythonDataReceived")
_TIME = ("pythonTotalTime", "pipelineTime", "sortTime", "shuffleWriteTime")
_SHOWN = ("Exchange", "MapInArrow", "FlatMapGroupsInArrow", "Sort", "BroadcastExchange")


def _nodes(plan, depth: int = 0):
    """Operators of a plan that has run, from the result down, through the stages of adaptive execution."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan(), depth)
        return
    if name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan(), depth)
        return
    yield depth, plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i), depth + 1)


def metrics(df: DataFrame) -> list[tuple[int, str, int, int, int, float]]:
    """(step, operator, rows, bytes stored, bytes of data, seconds of its tasks) for the exchanges and Python steps of the
    plan that a DataFrame's own action (``collect``, ``measure``) has run, in the order of the data; zeros before it."""
    out = []
    for _, plan in _nodes(df._jdf.queryExecution().executedPlan()):
        name = plan.nodeName()
        if name not in _SHOWN:
            continue
        have = plan.metrics()

        def total(names, have=have):
            return next((have.apply(m).value() for m in names if have.contains(m)), 0)

        time = max(0.0, next((have.apply(m).value() / (1e9 if m == "shuffleWriteTime" else 1e3) for m in _TIME if have.contains(m)), 0))
        out.append((name, max(0, total(_ROWS)), max(0, total(_BYTES)), max(0, total(_DATA)), time))
    return [(k, *row) for k, row in enumerate(reversed(out))]


def measure(df: DataFrame) -> DataFrame:
    """step, operator, rows, stored_bytes, data_bytes, task_seconds of one run of a DataFrame's plan as it is: nothing is
    cached or run apart, so these are the figures of the solve itself."""
    df._jdf.queryExecution().toRdd().count()
    return df.sparkSession.createDataFrame(metrics(df), "step int, operator string, rows long, stored_bytes long, data_bytes long, task_seconds double")


def profile(solver, field: DataFrame) -> DataFrame:
    """stage, seconds, rows, exchanges of a solve stage by stage, each run alone on the cached result of the one before."""
    spark, rows, held = field.sparkSession, [], []
    steps = [("input", lambda df: df)]
    if solver.grid.unbounded:
        steps.append(("green", lambda df: solver.green()))
    steps += [("forward", solver.forward), ("multiply", solver.multiply), ("backward", solver.backward)]
    state = field
    for name, step in steps:
        start = time.perf_counter()
        out = step(state)
        count = len(exchanges(out))
        cached = out.cache()
        n = cached.count()
        rows.append((name, time.perf_counter() - start, n, count))
        if name != "green":
            state = cached
            held.append(cached)
    for df in held:
        df.unpersist()
    return spark.createDataFrame(rows, "stage string, seconds double, rows long, exchanges int")
