"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_written, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Each row (u, v) with m, the least of u's neighbours. The sum is keyed by another value than the join, so that a hot u can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("key"), "m")
    return edges.withColumn("key", F.bitwise_not("u")).join(least, "key").select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node that has an edge to another one; the component is its least node.

    ``edges`` has two long columns; loops, repeated and reversed edges are fine, rows with a null count for nothing. No edges: no rows.
    Each round is written to the shared folder, so that lineage stays short and a lost executor costs one round at most.
    """
    a, b = edges.columns
    now = written(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    old = mark(now)
    for _ in range(max_rounds):
        if not old[0]:
            break
        after = written(_small_star(_large_star(now)), "edges")
        drop_written(now)
        now, new = after, mark(after)
        if new == old:
            break
        old = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
