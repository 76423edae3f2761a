"""What a query will do: its steps, what Spark expects it to cost, and Spark's plan."""

from __future__ import annotations

import contextlib
import io
import math
import re

from pyspark.sql import DataFrame

from ..functions import durations
from . import ast, compiler


def steps(q: ast.Query) -> list[str]:
    out = [f"scan {q.metric} from {q.start_ms} to {q.end_ms}"]
    if q.where is not None:
        out.append(f"filter {q.where}")
    if q.kind == "aggregate":
        by = [*q.group_by, *([f"time({durations.show(compiler.interval(q))})"] if q.window else [])]
        out.append("aggregate " + ", ".join(c.name for c in q.calls) + (" by " + ", ".join(by) if by else ""))
        if q.fill.kind != "none":
            out.append(f"fill {q.fill.kind}")
    elif q.kind == "downsample":
        out.append(f"downsample to {q.target} by {q.method}")
    elif q.kind == "latest":
        out.append(f"latest {q.limit or 1}")
    elif q.kind == "top":
        out.append(f"{'largest' if q.order[0][1] else 'smallest'} {q.limit}")
    if q.order and q.kind not in ("latest", "top"):
        out.append("order by " + ", ".join(f + (" desc" if d else "") for f, d in q.order))
    if q.limit is not None and q.kind not in ("latest", "top"):
        out.append(f"limit {q.limit} offset {q.offset}")
    return out


def cost(df: DataFrame) -> dict:
    """What Spark's statistics say before the run: scanned_bytes and files after pruning, result_bytes, tasks of the
    scan, shuffles, and effort: whether the scan is one task, one wave of tasks over the slots, or several."""
    spark = df.sparkSession
    execution = df._jdf.queryExecution()
    plan = execution.optimizedPlan()
    leaves = plan.collectLeaves()
    scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks, slots = max(1, math.ceil(scanned / split)), spark.sparkContext.defaultParallelism
    shuffles = len(re.findall(r"\bExchange (?:hash|range|SinglePartition|RoundRobin)", execution.executedPlan().toString()))
    effort = "one task" if tasks == 1 else "one wave" if tasks <= slots else f"{math.ceil(tasks / slots)} waves"
    return {"scanned_bytes": scanned, "files": len(df.inputFiles()), "result_bytes": int(str(plan.stats().sizeInBytes())), "tasks": tasks, "shuffles": shuffles, "effort": effort}


def spark_plan(df: DataFrame) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def explain(q: ast.Query, points: DataFrame, keep: str | None = None) -> DataFrame:
    """A row per line: part (step, cost, plan), line."""
    compiled = compiler.compile(q, points, keep)
    lines = [("step", "  " * i + s) for i, s in enumerate(steps(q))]
    lines += [("cost", f"{k}: {v}") for k, v in cost(compiled).items()]
    lines += [("plan", x) for x in spark_plan(compiled).splitlines()]
    return points.sparkSession.createDataFrame(lines, "part string, line string")
