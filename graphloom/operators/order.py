"""Positions over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.shared import written

_LOCAL = 33  # bits of a row's place in monotonically_increasing_id


def numbered(df: DataFrame, order: list[Column | str], name: str = "rn", start: int = 1) -> DataFrame:
    """Adds consecutive numbers in the order. Sorted by ranges; only the row count of each range meets in one place."""
    ranged = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_part", F.shiftright("_id", _LOCAL)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << _LOCAL) - 1))).drop("_id"), "numbered")
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total, rows = start, []
    for part, n in sizes:
        rows.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(rows, "_part long, _offset long")
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def running_sum(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one in the order: sums of ranges first, then within a range."""
    from pyspark.sql import Window

    ranged = written(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", _LOCAL)), "running")
    sums = sorted((r["_part"], r["n"] or 0) for r in ranged.groupBy("_part").agg(F.sum(value).alias("n")).collect())
    before, rows = 0, []
    for part, n in sums:
        rows.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_part long, _offset long")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.coalesce(inside, F.lit(0)) + F.col("_offset")).drop("_part", "_id", "_offset")


def counted(df: DataFrame, name: str = "n") -> DataFrame:
    """Adds the number of all rows to every row: one aggregate, joined as a single row."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def top_share(df: DataFrame, order: list[Column | str], share: float) -> DataFrame:
    """The first floor(share * N) rows of an order, one at least."""
    placed = numbered(df, order, "_rn")
    keep = max(1, int(share * placed.count()))
    return placed.where(F.col("_rn") <= keep).drop("_rn")
