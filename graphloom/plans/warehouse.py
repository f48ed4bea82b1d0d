"""Questions to the experiment warehouse: DataFrames in, a DataFrame out.

Steps are (variant_id, step_id, impl_id, min_time, avg_time, max_time), implementations (impl_id, name, type), runs (run_id, variant_id, impl_id,
validated, ts, total_time), variants (variant_id, graph_id, config_name). Implementations are a small dimension; all else may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import BEST_NON_SWITCHING, OPTIMAL, dense_vector, few_values, min_key, select_sample, total
from graphloom.shared import written

CORE = "Core"


def _ids(impls: DataFrame) -> Column:
    """All implementation ids as an array."""
    return F.array(*map(F.lit, few_values(impls, "impl_id"))).cast("array<bigint>")


def best_per_step(steps: DataFrame, impls: DataFrame, complete: bool = True) -> DataFrame:
    """(variant_id, step_id, best_impl, best_time): the core implementation with the least (avg, max, min); ``complete`` leaves out steps that lack an implementation."""
    core = steps.join(impls, "impl_id").withColumn("core", F.when(F.col("type") == CORE, F.col("impl_id")))
    key = F.when(F.col("core").isNotNull(), F.struct(*[x.alias(f"o{i}") for i, x in enumerate([F.col("avg_time").isNull(), F.col("avg_time"), F.col("max_time"), F.col("min_time"), F.col("impl_id")])]))
    found = core.groupBy("variant_id", "step_id").agg(F.min_by("impl_id", key).alias("best_impl"), F.min(F.when(F.col("core").isNotNull(), F.col("avg_time"))).alias("best_time"), F.count("*").alias("n"))
    return (found.where(F.col("n") == impls.count()) if complete else found).drop("n")


def step_info(steps: DataFrame, impls: DataFrame, properties: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """``best_per_step`` with the best one's place among the implementations (best_idx), and vectors of all timings and, if given, properties."""
    best = best_per_step(steps, impls, complete)
    place = F.create_map(*[F.lit(x) for i, impl in enumerate(few_values(impls, "impl_id")) for x in (impl, i)])
    out = best.withColumn("best_idx", place[F.col("best_impl")].cast("long"))
    out = out.join(dense_vector(impls, steps, ["variant_id", "step_id"], "impl_id", "avg_time", float("inf")).withColumnRenamed("vector", "timings"), ["variant_id", "step_id"])
    if properties is not None:
        vector = dense_vector(properties.select("prop_id"), properties, ["variant_id", "step_id"], "prop_id", "value", float("nan"))
        out = out.join(vector.withColumnRenamed("vector", "props"), ["variant_id", "step_id"], "left")
    return out


def variant_info(steps: DataFrame, runs: DataFrame, impls: DataFrame) -> DataFrame:
    """(variant_id, optimal, best_non_switching): the sum over steps of the best core time, and the least total of one core implementation."""
    core = impls.where(F.col("type") == CORE).select("impl_id")
    least = steps.join(core, "impl_id").groupBy("variant_id", "step_id").agg(F.min("avg_time").alias("m"))
    optimal = least.groupBy("variant_id").agg(F.sum("m").alias("optimal"))
    totals = runs.where("validated").join(core, "impl_id").groupBy("variant_id", "impl_id").agg(F.avg("total_time").alias("t"))
    return optimal.join(totals.groupBy("variant_id").agg(F.min("t").alias("best_non_switching")), "variant_id", "left")


def variant_vectors(steps: DataFrame, impls: DataFrame) -> DataFrame:
    """(variant_id, timings): for each variant a vector of the summed step times of every implementation, infinite where it has none."""
    each = steps.groupBy("variant_id", "impl_id").agg(F.sum("avg_time").alias("time"))
    return dense_vector(impls, each, ["variant_id"], "impl_id", "time", float("inf")).withColumnRenamed("vector", "timings")


def impl_totals(steps: DataFrame, impls: DataFrame) -> DataFrame:
    """(variant_id, impl_id, time): the sum over steps of each implementation, and of the best core one as -1, the best single core one as -2.

    A variant without any core step has null as -1 and no -2.
    """
    each = steps.groupBy("variant_id", "impl_id").agg(F.sum("avg_time").alias("time"))
    core = impls.where(F.col("type") == CORE).select("impl_id")
    marked = steps.join(core.withColumn("core", F.lit(True)), "impl_id", "left")
    optimal = marked.groupBy("variant_id", "step_id").agg(F.min(F.when(F.col("core"), F.col("avg_time"))).alias("m")).groupBy("variant_id").agg(F.sum("m").alias("time"))
    single = each.join(core, "impl_id").groupBy("variant_id").agg(F.min("time").alias("time"))
    fixed = lambda df, i: df.select("variant_id", F.lit(i).cast("long").alias("impl_id"), "time")
    return each.select("variant_id", "impl_id", "time").unionByName(fixed(optimal, OPTIMAL)).unionByName(fixed(single, BEST_NON_SWITCHING))


def train_steps(steps: DataFrame, variants: DataFrame, impls: DataFrame, seed: int, graphs: float, variant_part: float, step_part: float) -> DataFrame:
    """``best_per_step`` with keep: the step's graph, its variant and the step itself are in seeded samples of exact size."""
    info = best_per_step(steps, impls).join(variants.select("variant_id", "graph_id"), "variant_id")
    info = written(info.withColumn("step_key", F.concat_ws(":", "variant_id", "step_id")), "steps")  # each sample counts its keys
    info = select_sample(info, "graph_id", seed, 1, graphs).withColumnRenamed("keep", "g")
    info = select_sample(info, "variant_id", seed, 2, variant_part).withColumnRenamed("keep", "v")
    info = select_sample(info, "step_key", seed, 3, step_part)
    return info.withColumn("keep", F.col("g") & F.col("v") & F.col("keep")).drop("g", "v", "step_key")


def split(trained: DataFrame, mode: str) -> DataFrame:
    """Rows of ``train_steps`` for train (kept), validate (the rest) or all."""
    return {"train": trained.where("keep"), "validate": trained.where("not keep"), "all": trained}[mode]


def impl_rank(steps: DataFrame, column: str = "avg_time", ranking: str = "avg") -> DataFrame:
    """(impl_id, value): min, avg or total of min, avg or max step times."""
    how = {"min": F.min, "avg": F.avg, "total": total}[ranking]
    return steps.groupBy("impl_id").agg(how(column).alias("value"))


def time_plot(runs: DataFrame, variants: DataFrame, graphs: DataFrame, impls: DataFrame, config: str) -> DataFrame:
    """(variant_id, graph_id, graph, impl_id, time): mean total per implementation of each variant of a configuration; null where it did not run."""
    chosen = variants.where(F.col("config_name") == config).join(graphs.select("graph_id", F.col("name").alias("graph")), "graph_id")
    times = runs.groupBy("variant_id", "impl_id").agg(F.avg("total_time").alias("time"))
    slots = chosen.withColumn("impl_id", F.explode(_ids(impls)))
    return slots.join(times, ["variant_id", "impl_id"], "left").select("variant_id", "graph_id", "graph", "impl_id", "time")


def level_plot(steps: DataFrame, variant: int, impls: DataFrame) -> DataFrame:
    """(step_id, impl_id, time) of one variant, every implementation for each of its steps."""
    mine = steps.where(F.col("variant_id") == variant)
    slots = mine.select("step_id").distinct().withColumn("impl_id", F.explode(_ids(impls)))
    return slots.join(mine.select("step_id", "impl_id", F.col("avg_time").alias("time")), ["step_id", "impl_id"], "left")


def step_heatmap(steps: DataFrame, variants: DataFrame, impls: DataFrame, config: str) -> DataFrame:
    """A row for each (variant, step) of a configuration with a column for each implementation."""
    ids = few_values(impls, "impl_id")
    chosen = steps.join(variants.where(F.col("config_name") == config).select("variant_id"), "variant_id")
    return chosen.groupBy("variant_id", "step_id").agg(*[F.max(F.when(F.col("impl_id") == i, F.col("avg_time"))).alias(f"impl_{i}") for i in ids])


def missing_runs(variants: DataFrame, impls: DataFrame, runs: DataFrame, retries: int | None = None) -> DataFrame:
    """(variant_id, impl_id) without any run; with ``retries`` only of variants whose retry_count is less."""
    wanted = (variants if retries is None else variants.where(F.col("retry_count") < retries)).select("variant_id").withColumn("impl_id", F.explode(_ids(impls)))
    return wanted.join(runs.select("variant_id", "impl_id"), ["variant_id", "impl_id"], "left_anti")


def validation_variants(runs: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant_id, graph_id, unvalidated) of variants that have unvalidated runs."""
    open_runs = runs.where("not validated").groupBy("variant_id").agg(F.count("*").alias("unvalidated"))
    return open_runs.join(variants.select("variant_id", "graph_id"), "variant_id").select("variant_id", "graph_id", "unvalidated")


def validation_runs(runs: DataFrame, impls: DataFrame, variant: int | None = None) -> DataFrame:
    """(variant_id, run_id, impl_id, name) of the unvalidated runs of one variant, or of all."""
    mine = runs if variant is None else runs.where(F.col("variant_id") == variant)
    return mine.where(~F.col("validated")).join(impls, "impl_id").select("variant_id", "run_id", "impl_id", "name")


def distinct_field(df: DataFrame, field: str, prefix: str | None = None) -> DataFrame:
    """The values of a column, with a prefix if asked for."""
    from graphloom.operators.relational import starts_with

    out = df.select(field).where(F.col(field).isNotNull()).distinct()
    return out.where(starts_with(field, prefix)) if prefix else out


def best_impl(steps: DataFrame) -> DataFrame:
    """(variant_id, best_impl): the implementation of the least (avg, max) step, nulls last."""
    return steps.groupBy("variant_id").agg(min_key("impl_id", "avg_time", "max_time").alias("best_impl"))


def keep_properties(vectors: DataFrame, keep: set[int] | None = None, drop: set[int] | None = None, column: str = "props") -> DataFrame:
    """Vectors without the properties in ``drop``, and with those in ``keep`` alone unless it is empty."""
    wanted = lambda x: (F.lit(True) if not keep else x["key"].isin(*keep)) & (~x["key"].isin(*drop) if drop else F.lit(True))
    return vectors.withColumn(column, F.filter(column, wanted))


def default_variants(variants: DataFrame, graph_ids: str, config: str) -> DataFrame:
    """(graph_id, variant_id) of the graphs in an interval list under the default configuration; a graph without exactly one is an error."""
    from graphloom.functions import in_intervals

    chosen = variants.where(in_intervals("graph_id", graph_ids) & (F.col("config_name") == config)).groupBy("graph_id").agg(F.min("variant_id").alias("variant_id"), F.count("*").alias("n"))
    return chosen.select("graph_id", F.when(F.col("n") == 1, F.col("variant_id")).otherwise(F.raise_error(F.concat(F.lit("several default variants of graph "), F.col("graph_id").cast("string")))).alias("variant_id"))


def reset(table: DataFrame, column: str, value) -> DataFrame:
    """The table with one column set back for all rows."""
    return table.withColumn(column, F.lit(value).cast(table.schema[column].dataType))
