"""Looking at queries: plans, counts, times."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan that ``explain`` prints."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def timed(df: DataFrame) -> tuple[int, float]:
    """Rows of a whole result, and wall seconds with three decimals."""
    began = time.perf_counter()
    n = df.count()
    return n, round(time.perf_counter() - began, 3)


def repeated(spark: SparkSession, work: Callable[[], object], name: str, repeats: int = 1) -> DataFrame:
    """(name, min_time, avg_time, max_time, std_dev) of wall nanoseconds over some runs; the deviation is that of a sample, 0 for one run."""
    rows = []
    for _ in range(repeats):
        began = time.perf_counter_ns()
        work()
        rows.append((name, time.perf_counter_ns() - began))
    spread = F.coalesce(F.stddev_samp("t"), F.lit(0.0)).alias("std_dev")
    return spark.createDataFrame(rows, "name string, t long").groupBy("name").agg(F.min("t").alias("min_time"), F.avg("t").alias("avg_time"), F.max("t").alias("max_time"), spread)


def time_search(graph: Graph, root: int = 0, strategy: str = "switch", repeats: int = 1) -> DataFrame:
    """Total times of a search."""
    return repeated(graph.edges.sparkSession, lambda: graph.bfs(root, strategy).count(), f"bfs {strategy}", repeats)
