"""Ingestion of logs, as batches and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.logs import parse_timings

MAX_RETRIES = 5


def classify_properties(rows: DataFrame, known: DataFrame, max_steps: DataFrame) -> DataFrame:
    """Adds ``state`` to parsed property rows (variant_id, kind, step_id, name, number).

    ``invalid``: not parsed or no number; ``unknown``: a property that is not declared; ``out_of_range``: a step beyond the variant's last; else ``ok``.
    """
    joined = rows.join(known.select(F.col("property").alias("name"), F.lit(True).alias("_known")), "name", "left").join(max_steps.select("variant_id", "max_step"), "variant_id", "left")
    state = (
        F.when((F.col("kind") == "invalid") | F.col("number").isNull(), "invalid")
        .when((F.col("kind") != "prediction") & F.col("_known").isNull(), "unknown")
        .when(F.col("step_id") > F.col("max_step"), "out_of_range")
        .otherwise("ok")
    )
    return joined.withColumn("state", state).drop("_known")


def ingest_timings(runs: DataFrame, timings: DataFrame, expected: DataFrame, commit: str) -> tuple[DataFrame, DataFrame]:
    """Splits runs (run_id, variant_id, result, version, max_step) into accepted ones, with ``validated``, and rejected ones, with ``reason``.

    A run is rejected if its version is not ``commit`` or a timing's step lies beyond its last; it is validated if its result equals the
    variant's expected result.
    """
    last = timings.groupBy("run_id").agg(F.max("step_id").alias("_last"))
    joined = runs.join(last, "run_id", "left").join(expected.select("variant_id", F.col("result").alias("_expected")), "variant_id", "left")
    reason = F.when(~F.col("version").eqNullSafe(F.lit(commit)), "version").when(F.col("_last") > F.col("max_step"), "step")
    judged = joined.withColumn("reason", reason).withColumn("validated", F.coalesce(F.col("result") == F.col("_expected"), F.lit(False))).drop("_last", "_expected")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").drop("validated")


def retry(variants: DataFrame, failed: DataFrame, timed_out: DataFrame) -> DataFrame:
    """Variants with ``retry_count`` after a round: a timeout leaves it, another failure adds 1; those with 5 or more are dropped."""
    marks = failed.select("variant_id").distinct().join(timed_out.select("variant_id").distinct(), "variant_id", "left_anti").withColumn("_failed", F.lit(1))
    after = variants.join(marks, "variant_id", "left").withColumn("retry_count", F.col("retry_count") + F.coalesce("_failed", F.lit(0))).drop("_failed")
    return after.where(F.col("retry_count") < MAX_RETRIES)


def map_rows(df: DataFrame, work: Callable[[dict], dict | None], schema: str, on_error: str = "drop") -> DataFrame:
    """Applies ``work`` to each row in parallel; an error drops the row, or fails the task, which Spark then tries again (``retry``)."""
    if on_error not in ("drop", "retry"):
        raise ValueError(on_error)

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    made = work(row)
                except Exception:
                    if on_error == "retry":
                        raise
                    continue
                if made is not None:
                    out.append(made)
            if out:
                yield pd.DataFrame(out)

    return df.mapInPandas(run, schema)


def stream_timings(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True):
    """A stream of log files that arrive in ``folder``: parsed timings go to ``target``/ok, other lines to ``target``/rejected."""

    def both(batch: DataFrame, n: int) -> None:
        parsed = parse_timings(batch).withColumn("batch", F.lit(n)).persist()
        parsed.where("ok").drop("ok").write.mode("overwrite").parquet(f"{target}/ok/part={n}")
        parsed.where("not ok").select("value").write.mode("overwrite").parquet(f"{target}/rejected/part={n}")
        parsed.unpersist()

    writer = spark.readStream.text(folder).writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
