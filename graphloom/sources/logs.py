"""Text logs of runs: timings, properties and results of other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBER = r"([-+0-9.eE]+|nan|inf)"
_TIMING = rf"^(?:([0-9]+):)?([^:]+):{_NUMBER} {_NUMBER} {_NUMBER} {_NUMBER}$"


def _number(column):
    return F.expr(f"try_cast({column} as double)") if isinstance(column, str) else column.try_cast("double")


def parse_timings(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds step_id (null for totals), name, min_time, avg_time, max_time, std_dev and ``ok`` to lines ``[step:]name:min avg max stddev``; commas in numbers go."""
    text = F.regexp_replace(F.trim(value), ",", "")
    part = lambda i: F.regexp_extract(text, _TIMING, i)
    out = lines.withColumn("ok", F.coalesce(text.rlike(_TIMING), F.lit(False)))
    out = out.withColumn("step_id", F.when(part(1) != "", part(1).try_cast("long"))).withColumn("name", F.when(F.col("ok"), part(2)))
    for i, c in enumerate(("min_time", "avg_time", "max_time", "std_dev"), 3):
        out = out.withColumn(c, F.when(F.col("ok"), part(i).try_cast("double")))
    return out


def parse_properties(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds kind (graph, step, prediction or invalid), step_id, name and number to lines ``graph:name:v``, ``step:n:name:v`` and ``prediction:n:id``."""
    parts = F.split(F.trim(value), ":")
    kind, size = F.get(parts, 0), F.size(parts)
    graph, step, prediction = (kind == "graph") & (size == 3), (kind == "step") & (size == 4), (kind == "prediction") & (size == 3)
    return (
        lines.withColumn("kind", F.when(graph | step | prediction, kind).otherwise("invalid"))
        .withColumn("step_id", F.when(step | prediction, F.get(parts, 1).try_cast("long")))
        .withColumn("name", F.when(graph, F.get(parts, 1)).when(step, F.get(parts, 2)))
        .withColumn("number", F.when(graph | prediction, F.get(parts, 2)).when(step, F.get(parts, 3)).try_cast("double"))
    )


def parse_external(lines: DataFrame, graphs: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines ``graph:dataset_id:avg`` as (graph_id, avg_time, min_time, max_time, std_dev), and the lines whose graph (name, dataset_id) is unknown."""
    parts = F.split(F.trim(value), ":")
    rows = lines.select(F.get(parts, 0).alias("name"), F.get(parts, 1).try_cast("long").alias("dataset_id"), F.get(parts, 2).try_cast("double").alias("avg_time"))
    known = rows.join(graphs.select("graph_id", "name", "dataset_id"), ["name", "dataset_id"])
    zero = F.lit(0.0)
    return known.select("graph_id", "avg_time", zero.alias("min_time"), zero.alias("max_time"), zero.alias("std_dev")), rows.join(graphs, ["name", "dataset_id"], "left_anti")


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct("*")).alias("line"))


def digest_of_lines(df: DataFrame, line: str, by: list[str] | None = None) -> DataFrame:
    """An order-free digest of a result's lines per group: their count, and a sum over md5 values, built up in any order.

    Unlike the md5 of one concatenated file it needs no task that holds all lines.
    """
    word = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("decimal(38,0)")
    found = df.groupBy(*(by or [])).agg(F.count("*").alias("lines"), F.sum(word).cast("string").alias("digest"))
    return found
