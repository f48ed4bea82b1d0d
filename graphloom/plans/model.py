"""Decision trees over step properties, and reports on how well they choose implementations."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import OPTIMAL
from graphloom.operators.relational import latest_valid


@dataclass(frozen=True)
class TreeNode:
    """An inner node goes left if ``prop <= threshold`` (never for NaN or null); a leaf has ``left`` -1 and its answer in ``right``."""

    threshold: float
    prop: str
    left: int
    right: int


#: Spark's trainer grows no deeper tree.
DEEPEST = 30


def tree_column(tree: Sequence[TreeNode], at: int = 0) -> Column:
    """The tree's answer as one expression. A negative answer names a set of implementations that the tree could not tell apart."""
    node = tree[at]
    if node.left == -1:
        return F.lit(node.right).cast("long")
    return F.when(F.col(node.prop) <= F.lit(node.threshold), tree_column(tree, node.left)).otherwise(tree_column(tree, node.right))


def tree_sql(tree: Sequence[TreeNode], at: int = 0) -> str:
    node = tree[at]
    if node.left == -1:
        return f"CAST({node.right} AS BIGINT)"
    return f"CASE WHEN {node.prop} <= {node.threshold} THEN {tree_sql(tree, node.left)} ELSE {tree_sql(tree, node.right)} END"


def tree_json(tree: Sequence[TreeNode]) -> str:
    return json.dumps([n.__dict__ for n in tree])


def resolve_sets(unknown: dict[int, list[int]], strategy: str = "firstinset", ranks: dict[int, float] | None = None) -> dict[int, int | None]:
    """An implementation for each set of those that a leaf could not tell apart: none, the smallest id, or the best ranked (least value)."""
    if strategy == "none":
        return dict.fromkeys(unknown)
    if strategy == "firstinset":
        return {k: min(v) for k, v in unknown.items()}
    return {k: min(v, key=lambda i: ((ranks or {}).get(i, float("inf")), i)) for k, v in unknown.items()}


#: What a ranked strategy sums up of an implementation's measurements, and how.
RANKED = [f"{time}-{how}" for time in ("min", "avg", "max") for how in ("min", "avg", "total")]


def strategy_ranks(steps: DataFrame) -> DataFrame:
    """(strategy, impl_id, value) for each of the nine ranked strategies, in one pass: the least, mean and total of each implementation's min, avg and max times."""
    by = {"min": F.min, "avg": F.avg, "total": F.sum}
    each = [F.struct(F.lit(name).alias("strategy"), by[name.split("-")[1]](F.col(f"{name.split('-')[0]}_time").cast("double")).alias("value")) for name in RANKED]
    return steps.groupBy("impl_id").agg(F.array(*each).alias("all")).select("impl_id", F.explode("all").alias("x")).select("x.strategy", "impl_id", "x.value")


def resolve_ranked(unknown: dict[int, list[int]], steps: DataFrame) -> dict[str, dict[int, int | None]]:
    """For each ranked strategy an implementation for each set. Implementations are a small dimension: nine values of each reach the driver."""
    ranks: dict[str, dict[int, float]] = {name: {} for name in RANKED}
    for r in strategy_ranks(steps).where(F.col("impl_id").isin([i for v in unknown.values() for i in v])).collect():
        ranks[r["strategy"]][r["impl_id"]] = r["value"]
    return {name: resolve_sets(unknown, name, found) for name, found in ranks.items()}


def merged_diffs(diffs: DataFrame) -> DataFrame:
    """One row per field of several differences: the greatest absolute and relative ones, and all errors."""
    return diffs.groupBy("field").agg(F.max("max_abs").alias("max_abs"), F.max("max_rel").alias("max_rel"), F.sum("errors").alias("errors"))


def predict(steps: DataFrame, tree: Sequence[TreeNode], default: int, unknown: dict[int, int | None] | None = None) -> DataFrame:
    """Adds ``answer`` (the tree's, null if a set stays unresolved) and ``impl``: the last answer of the variant up to the step, else ``default``."""
    answer = tree_column(tree)
    table = {-k: v for k, v in (unknown or {}).items() if v is not None}
    if table:
        mapped = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for kv in table.items() for x in kv]), F.col("answer"))
    else:
        mapped = F.lit(None).cast("long")
    out = steps.withColumn("answer", answer).withColumn("answer", F.when(F.col("answer") < 0, mapped).otherwise(F.col("answer")))
    return out.withColumn("impl", F.coalesce(latest_valid("answer", ["variant_id"], "step_id"), F.lit(default).cast("long")))


def predicted_totals(predicted: DataFrame, steps: DataFrame, impl_id: int) -> DataFrame:
    """(variant_id, impl_id, time) of following a prediction, under the id of the predictor."""
    times = steps.select("variant_id", "step_id", F.col("impl_id").alias("impl"), "avg_time")
    return predicted.select("variant_id", "step_id", "impl").join(times, ["variant_id", "step_id", "impl"]).groupBy("variant_id").agg(F.sum("avg_time").alias("time")).select("variant_id", F.lit(impl_id).cast("long").alias("impl_id"), "time")


def evaluate(totals: DataFrame, reference: int = OPTIMAL) -> DataFrame:
    """Per implementation over all variants: total time by total reference, mean relative time, how many under 2, over 5 and over 20 times, and the greatest."""
    base = totals.where(F.col("impl_id") == reference).select("variant_id", F.col("time").alias("base")).where("base > 0")
    rel = totals.join(base, "variant_id").withColumn("rel", F.col("time") / F.col("base"))
    return rel.groupBy("impl_id").agg(
        (F.sum("time") / F.sum("base")).alias("total_ratio"), F.avg("rel").alias("avg_rel"),
        F.count_if(F.col("rel") < 2).alias("lt2"), F.count_if(F.col("rel") > 5).alias("gt5"), F.count_if(F.col("rel") > 20).alias("gt20"), F.max("rel").alias("max_rel"),
    )


def report_order(report: DataFrame, value: str) -> DataFrame:
    """The optimum first, then by value, then by id."""
    return report.orderBy(F.when(F.col("impl_id") == OPTIMAL, 0).otherwise(1), value, "impl_id")


def validate(predicted: DataFrame, truth: DataFrame, sets: dict[int, list[int]] | None = None) -> DataFrame:
    """(counter, value): right, partial (the truth is in the leaf's set), wrong, unknown, total. ``predicted`` has the tree's raw answer."""
    members = F.create_map(*[x for k, v in (sets or {0: []}).items() for x in (F.lit(-k).cast("long"), F.array(*[F.lit(i).cast("long") for i in v]).cast("array<bigint>"))])
    joined = predicted.select("variant_id", "step_id", "raw").join(truth.select("variant_id", "step_id", F.col("best_impl").alias("truth")), ["variant_id", "step_id"])
    kind = (
        F.when(F.col("raw") == F.col("truth"), "right").when(F.col("raw").isNull(), "unknown")
        .when(F.col("raw") < 0, F.when(F.coalesce(F.array_contains(F.try_element_at(members, F.col("raw")), F.col("truth")), F.lit(False)), "partial").otherwise("wrong")).otherwise("wrong")
    )
    found = joined.groupBy(kind.alias("counter")).agg(F.count("*").alias("value"))
    all_rows = joined.agg(F.count("*").alias("value")).select(F.lit("total").alias("counter"), "value")
    return found.unionByName(all_rows)


def validation_report(predicted: DataFrame, truth: DataFrame, sets: dict[int, list[int]], refined: dict[int, int | None] | None = None) -> DataFrame:
    """One row of counters and error rates for the tree's raw answers, those that name a set replaced by ``refined``.

    right_n, partial_n (the truth and, if there is one, the refined answer are in the set), wrong_n and unknown_n (no answer) cover all steps;
    right_refined, partial_refined and wrong_refined (the truth is in the set, the refined answer is not) the refined ones.
    Hard errors are the wrong ones, soft errors the partial ones too, as shares of their counters' sum (null if that is 0).
    """
    long = lambda x: F.lit(x).cast("long")
    table = lambda d: F.create_map(*[x for kv in d for x in kv]) if d else None
    members = table([(long(-k), F.array(*map(long, v)).cast("array<bigint>")) for k, v in sets.items()])
    answers = table([(long(-k), long(v)) for k, v in (refined or {}).items() if v is not None])
    raw, best, of_set = F.col("raw"), F.col("truth"), F.col("raw") < 0
    at = lambda m, kind: F.lit(None).cast(kind) if m is None else F.when(of_set, F.try_element_at(m, raw))
    joined = predicted.select("variant_id", "step_id", "raw").join(truth.select("variant_id", "step_id", F.col("best_impl").alias("truth")), ["variant_id", "step_id"])
    rows = joined.select("raw", "truth", at(answers, "bigint").alias("answer"), F.coalesce(at(members, "array<bigint>"), F.array().cast("array<bigint>")).alias("set"))
    said, has = F.coalesce("answer", "raw"), F.col("answer").isNotNull()
    right = F.coalesce(said == best, F.lit(False))
    among = ~right & F.coalesce(F.array_contains("set", best), F.lit(False))
    fits = ~has | F.array_contains("set", F.col("answer"))
    counts = rows.agg(
        F.count_if(right).alias("right_n"), F.count_if(among & fits).alias("partial_n"), F.count_if(raw.isNotNull() & ~right & ~(among & fits)).alias("wrong_n"), F.count_if(raw.isNull()).alias("unknown_n"),
        F.count_if(right & has).alias("right_refined"), F.count_if(among & has & fits).alias("partial_refined"), F.count_if(among & has & ~fits).alias("wrong_refined"),
    )
    all_n, all_refined = F.expr("right_n + partial_n + wrong_n + unknown_n"), F.expr("right_refined + partial_refined + wrong_refined")
    rate = lambda part, whole: F.try_divide(F.expr(part).cast("double"), whole)
    return counts.select(
        "*", rate("wrong_n", all_n).alias("hard_error"), rate("wrong_n + partial_n", all_n).alias("soft_error"),
        rate("wrong_refined", all_refined).alias("hard_refined_error"), rate("wrong_refined + partial_refined", all_refined).alias("soft_refined_error"),
    )


def interesting(totals: DataFrame) -> DataFrame:
    """(criterion, variant_id): where each implementation is relatively best and worst, and where the spread of times is greatest by several measures.

    A variant's least time comes from the same rows as its other times: sums that were computed twice may differ in the last bit, and the fastest would not be 1.
    """
    all_times = Window.partitionBy("variant_id").orderBy("time", "impl_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = {"least": F.min("time"), "most": F.max("time"), "sd": F.stddev_pop("time"), "mean": F.avg("time")}
    rows = totals.where((F.col("impl_id") >= 0) & F.col("variant_id").isNotNull()).select("variant_id", "impl_id", "time", *[v.over(all_times).alias(k) for k, v in spread.items()]).where("least > 0")
    rel, of_impl = F.col("time") / F.col("least"), lambda n: F.concat_ws(" ", F.lit(n), F.col("impl_id"))
    scores = [(of_impl("best"), -rel), (of_impl("worst"), rel), (F.lit("ratio"), F.col("most") / F.col("least")), (F.lit("deviation"), F.col("sd") / F.col("mean"))]
    named = rows.select("variant_id", F.explode(F.array(*[F.struct(k.alias("criterion"), v.alias("score")) for k, v in scores])).alias("x")).select("variant_id", "x.*")
    none = totals.sparkSession.createDataFrame([(None, "ratio", None), (None, "deviation", None)], "variant_id long, criterion string, score double")  # those two have a row even without variants
    return named.unionByName(none).groupBy("criterion").agg(F.max_by("variant_id", F.struct("score", -F.col("variant_id"))).alias("variant_id"))


def shape(totals: DataFrame) -> DataFrame:
    """(impl_id, skewness, kurtosis) of times, population moments, kurtosis in excess of the normal."""
    return totals.groupBy("impl_id").agg(F.skewness("time").alias("skewness"), F.kurtosis("time").alias("kurtosis"))


def normalised(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``value`` by the slowest finite one of its group."""
    finite = F.when(F.col(value) < F.lit(float("inf")), F.col(value))
    return df.withColumn("normalised", F.try_divide(F.col(value), F.max(finite).over(Window.partitionBy(*by))))


def output_diff(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], tolerance: float = 0.025) -> DataFrame:
    """(field, max_abs, max_rel, errors): differences of two results row by row, relative to the first; keys that one lacks count as errors."""
    left = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).withColumn("_a", F.lit(1))
    right = b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]).withColumn("_b", F.lit(1))
    rows = left.join(right, key, "full").select("_a", "_b", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("double").alias("x"), F.col(f"b_{f}").cast("double").alias("y")) for f in fields])).alias("d")).select("_a", "_b", "d.*")
    gap = F.abs(F.col("x") - F.col("y"))
    rel = F.when((F.col("x") == 0) & (F.col("y") == 0), 0.0).when(F.col("x") == 0, float("inf")).otherwise(F.try_divide(gap, F.abs("x")))
    lone = F.col("_a").isNull() | F.col("_b").isNull()
    return rows.groupBy("field").agg(F.max(gap).alias("max_abs"), F.max(rel).alias("max_rel"), F.count_if(lone | (rel > tolerance)).alias("errors"))


def accepted(diff: DataFrame) -> bool:
    """No difference beyond the tolerance, or at most two and none of 5 % or more."""
    worst = diff.agg(F.max("max_rel").alias("rel"), F.sum("errors").alias("n")).first()
    return not worst["n"] or (worst["rel"] < 0.05 and worst["n"] <= 2)


def train_tree(rows: DataFrame, features: list[str], label: str, depth: int = DEEPEST, seed: int = 42) -> tuple[list[TreeNode], dict[str, float], dict[int, list[int]], dict[int, int]]:
    """A decision tree, its feature importances, its unknown sets and each one's number of leaves, learnt by Spark's distributed trainer.

    A leaf where no label has more than half of the rows answers with a negative set id: the set holds all labels of its rows, and ids run from 2 in
    order of the levels. The trainer joins leaves of equal most frequent label before that.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double")))
    fitted = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", maxDepth=depth, seed=seed).fit(vectors)
    nodes: list[TreeNode] = []
    unclear: dict[int, tuple[int, ...]] = {}

    def add(node) -> int:
        at = len(nodes)
        nodes.append(TreeNode(0.0, "", -1, -1))
        if node.numDescendants() == 0:
            nodes[at] = TreeNode(0.0, "", -1, int(node.prediction()))
            rows_of = list(node.impurityStats().stats())
            if 2 * max(rows_of) <= sum(rows_of):
                unclear[at] = tuple(k for k, n in enumerate(rows_of) if n)
        else:
            s = node.split()
            left = add(node.leftChild())
            nodes[at] = TreeNode(float(s.threshold()), features[s.featureIndex()], left, add(node.rightChild()))
        return at

    add(fitted._java_obj.rootNode())
    ids: dict[tuple[int, ...], int] = {}
    leaves: dict[int, int] = {}
    level = [0]
    while level:
        for at in level:
            if at in unclear:
                found = ids.setdefault(unclear[at], len(ids) + 2)
                leaves[found] = leaves.get(found, 0) + 1
                nodes[at] = TreeNode(0.0, "", -1, -found)
        level = [to for at in level if nodes[at].left != -1 for to in (nodes[at].left, nodes[at].right)]
    return nodes, dict(zip(features, fitted.featureImportances.toArray().tolist(), strict=True)), {i: list(members) for members, i in ids.items()}, leaves


def unknown_report(sets: dict[int, list[int]], leaves: dict[int, int]) -> list[tuple[int, list[int], int]]:
    """(set id, members, leaves) of a trained tree's unknown sets, by leaves, then by id."""
    return sorted(((i, members, leaves[i]) for i, members in sets.items()), key=lambda x: (-x[2], x[0]))


def prediction_report(predicted: DataFrame, best: DataFrame, steps: DataFrame) -> DataFrame:
    """(variant_id, step_id, impl, best_impl, relative): each step's choice, the best one, and how much slower the choice was."""
    times = steps.select("variant_id", "step_id", F.col("impl_id").alias("impl"), "avg_time")
    joined = predicted.select("variant_id", "step_id", "impl").join(best, ["variant_id", "step_id"]).join(times, ["variant_id", "step_id", "impl"], "left")
    return joined.select("variant_id", "step_id", "impl", "best_impl", F.try_divide("avg_time", "best_time").alias("relative"))


def relative_to_optimal(totals: DataFrame) -> DataFrame:
    """(variant_id, impl_id, relative): each total by the optimum of its variant; variants without an optimum are left out."""
    base = totals.where((F.col("impl_id") == OPTIMAL) & F.col("time").isNotNull()).select("variant_id", F.col("time").alias("base"))
    return totals.join(base, "variant_id").select("variant_id", "impl_id", F.try_divide("time", "base").alias("relative"))


def importance_report(importances: dict[str, float]) -> list[tuple[str, float]]:
    """Features by importance, then by name."""
    return sorted(importances.items(), key=lambda x: (-x[1], x[0]))
