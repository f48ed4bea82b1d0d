import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import functions as fn
from graphloom.operators import relational
from graphloom.operators.order import counted, numbered, running_sum, top_share
from graphloom.plans import model, tables, warehouse
from graphloom.sources import logs
from graphloom.streaming import stream_timings


def test_min_key_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 3, 1.0), ("a", 2, 1.0), ("a", 1, None), ("b", 5, None)], "g string, k long, v double")
    assert {r["g"]: r["m"] for r in rows.groupBy("g").agg(fn.min_key("k", "v").alias("m")).collect()} == {"a": 2, "b": 5}


@settings(max_examples=8, deadline=None)
@given(n=st.integers(0, 40), part=st.floats(0, 1))
def test_sample_is_exact(spark, n, part):
    rows = spark.range(n).select(F.col("id").alias("k"))
    kept = fn.select_sample(rows.union(rows), "k", 7, 1, part).where("keep")
    assert kept.distinct().count() == math.floor(part * n) and kept.count() == 2 * math.floor(part * n)


def test_sample_refuses_odd_parts(spark):
    with pytest.raises(ValueError):
        fn.select_sample(spark.range(3), "id", 1, 1, 1.5)


def test_transitions_begin_with_null(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, 5), (5, None)], "t long, x long").withColumn("g", F.lit(1))
    assert rows.withColumn("c", fn.count_transitions("x", ["g"], ["t"])).agg(F.sum("c")).first()[0] == 3


def test_dense_vector_defaults(spark):
    keys = spark.createDataFrame([(1,), (2,), (4,)], "k long")
    facts = spark.createDataFrame([("a", 2, 1.0, 1), ("a", 2, 9.0, 2), ("b", None, 3.0, 1)], "g string, k long, v double, run long")
    got = {r["g"]: [(x["key"], x["value"]) for x in r["vector"]] for r in fn.dense_vector(keys, facts, ["g"], "k", "v", math.inf, latest="run").collect()}
    assert got["a"] == [(1, math.inf), (2, 9.0), (4, math.inf)]


def test_scalars(spark):
    row = spark.range(1).select(fn.percentage(F.lit(0.12345)).alias("p"), fn.greatest_or_null(F.lit(1), F.lit(None).cast("int")).alias("g"), fn.triangle_row(F.lit(5).cast("long")).alias("t"), fn.masked_float(F.lit(1.23456789)).alias("m")).first()
    assert row["p"] == "12.35%" and row["g"] is None and row["t"] == 2 and abs(row["m"] - 1.23456789) < 0.01


def test_numbers_and_sums_over_all_rows(spark):
    rows = spark.range(1000).repartition(7)
    assert [r["rn"] for r in numbered(rows, [F.desc("id")]).orderBy(F.desc("id")).collect()] == list(range(1, 1001))
    assert {r["id"]: r["s"] for r in running_sum(rows, ["id"], "id", "s").collect()} == {i: i * (i - 1) // 2 for i in range(1000)}
    assert numbered(rows.limit(0), ["id"]).count() == 0


def test_single_row(spark):
    assert relational.single_row(spark.range(1))["id"] == 0 and relational.single_row(spark.range(0), optional=True) is None
    for n in (0, 2):
        with pytest.raises(LookupError):
            relational.single_row(spark.range(n))


def test_like_takes_its_text_literally(spark):
    rows = spark.createDataFrame([("a%b",), ("axb",), ("A%B",)], "s string")
    assert sorted(r["s"] for r in rows.where(relational.contains("s", "%b")).collect()) == ["A%B", "a%b"]


def test_split_and_weighted_sample(spark):
    a, b = relational.random_split(spark.range(20), "id", 3, 8)
    assert a.count() == 8 and a.intersect(b).count() == 0 and a.union(b).distinct().count() == 20
    assert relational.weighted_sample(spark.range(20).withColumn("w", F.col("id").cast("double")), "w", "id", 5, 1).distinct().count() == 5


def test_tree_sends_nan_and_null_right(spark):
    tree = [model.TreeNode(1.0, "x", 1, 2), model.TreeNode(0, "", -1, 10), model.TreeNode(0, "", -1, 20)]
    rows = spark.createDataFrame([(0.5,), (float("nan"),), (None,)], "x double")
    assert [r["a"] for r in rows.select(model.tree_column(tree).alias("a")).collect()] == [10, 20, 20]
    assert model.tree_sql(tree).startswith("CASE WHEN x <= 1.0") and "threshold" in model.tree_json(tree)


def test_unknown_sets():
    assert model.resolve_sets({2: [3, 1]}) == {2: 1} and model.resolve_sets({2: [3, 1]}, "none") == {2: None}
    assert model.resolve_sets({2: [3, 1]}, "avg-min", {3: 0.5, 1: 0.7}) == {2: 3}


def test_unclear_leaves_become_unknown_sets(spark):
    rows = [(x, y) for x, ys in {0: [1, 1, 1], 1: [2, 3], 2: [4, 4, 4, 2], 3: [0, 4]}.items() for y in ys for _ in range(3)]
    tree, _, sets, leaves = model.train_tree(spark.createDataFrame(rows, "x long, y long"), ["x"], "y")
    answer = {r["x"]: r["a"] for r in spark.range(4).withColumnRenamed("id", "x").select("x", model.tree_column(tree).alias("a")).collect()}
    assert answer[0] == 1 and answer[2] == 4 and answer[1] < -1 and answer[3] < -1
    assert sets == {-answer[1]: [2, 3], -answer[3]: [0, 4]} and set(sets) == {2, 3} and leaves == {2: 1, 3: 1}
    assert model.unknown_report({2: [1], 3: [4]}, {2: 1, 3: 5}) == [(3, [4], 5), (2, [1], 1)]


def test_prediction_is_carried_forward(spark):
    tree = [model.TreeNode(1.0, "x", 1, 2), model.TreeNode(0, "", -1, -2), model.TreeNode(0, "", -1, 9)]
    rows = spark.createDataFrame([(1, 0, 0.0), (1, 1, 5.0), (1, 2, 0.0)], "variant_id long, step_id long, x double")
    got = {r["step_id"]: r["impl"] for r in model.predict(rows, tree, 4).collect()}
    assert got == {0: 4, 1: 9, 2: 9}


def test_output_diff(spark):
    a = spark.createDataFrame([(1, 1.0), (2, -2.0), (3, 0.0)], "id long, x double")
    b = spark.createDataFrame([(1, 1.01), (2, -2.0), (3, 0.0)], "id long, x double")
    assert model.accepted(model.output_diff(a, b, "id", ["x"]))
    assert not model.accepted(model.output_diff(a, b.withColumn("x", F.col("x") * 2), "id", ["x"]))
    assert model.output_diff(a, b.where("id < 3"), "id", ["x"]).first()["errors"] == 1


def test_table_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new, clash = tables.insert_new(t, spark.createDataFrame([(2, "c"), (3, "d"), (1, "a")], "k long, v string"), ["k"])
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "b"), (3, "d")] and [tuple(r) for r in clash.collect()] == [(2, "c")]
    assert tables.delete_where(t, F.col("v") == "a").count() == 1
    assert sorted(r["v"] for r in tables.backfill(t, spark.createDataFrame([(1, "z")], "k long, v string"), ["k"], ["v"]).collect()) == ["b", "z"]
    assert tables.several_defaults(t.withColumn("d", F.lit(True)).withColumn("g", F.lit(1)), "g", "d").first()["defaults"] == 2


def test_log_lines(spark):
    lines = spark.createDataFrame([("3:bfs:1,000 2.5 3 0.1",), ("total:1 2 3 4",), ("nonsense",), (None,)], "value string")
    got = logs.parse_timings(lines).collect()
    assert [(r["ok"], r["step_id"], r["name"], r["min_time"]) for r in got] == [(True, 3, "bfs", 1000.0), (True, None, "total", 1.0), (False, None, None, None), (False, None, None, None)]
    assert [r["kind"] for r in logs.parse_properties(spark.createDataFrame([("graph:a:1",), ("step:1:b:2",), ("prediction:1:2",), ("x",)], "value string")).collect()] == ["graph", "step", "prediction", "invalid"]


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("1:x:1 2 3 4\nbad\n")
    stream_timings(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out/ok").count() == 1 and spark.read.parquet(f"file://{tmp_path}/out/rejected").count() == 1


def test_ranked_strategies(spark):
    steps = spark.createDataFrame([(1, 5.0, 5.0, 5.0), (2, 1.0, 4.0, 9.0), (2, 2.0, 4.0, 9.0)], "impl_id long, min_time double, avg_time double, max_time double")
    got = model.resolve_ranked({2: [1, 2]}, steps)
    assert set(got) == set(model.RANKED) and all(got[f"{t}-total"][2] == (2 if t == "min" else 1) for t in ("min", "avg", "max"))
    assert got["min-min"][2] == got["avg-avg"][2] == 2 and got["max-avg"][2] == 1


def test_shares_and_counts(spark):
    rows = spark.range(10).select(F.col("id").alias("k"))
    assert sorted(r["k"] for r in top_share(rows, [F.desc("k")], 0.25).collect()) == [8, 9] and top_share(rows, ["k"], 0.0).count() == 1
    assert {r["n"] for r in counted(rows).collect()} == {10} and counted(rows.limit(0)).count() == 0
    assert top_share(rows.limit(0), ["k"], 0.5).count() == 0


def test_shared_folder_is_not_local_on_a_cluster(spark):
    from types import SimpleNamespace

    from graphloom import shared

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        shared.shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf))


def test_refined_answers_outside_their_set(spark):
    rows = [(1, 0, 1), (1, 1, -2), (1, 2, -2), (1, 3, -2), (1, 4, None), (1, 5, -3), (1, 6, -3)]
    truth = spark.createDataFrame([(1, i, t) for i, t in enumerate([1, 1, 2, 3, 1, 4, 1])], "variant_id long, step_id long, best_impl long")
    predicted = spark.createDataFrame(rows, "variant_id long, step_id long, raw long")
    got = model.validation_report(predicted, truth, {2: [1, 2], 3: [4, 5]}, {2: 1, 3: 9}).first().asDict()
    assert [got[k] for k in ("right_n", "partial_n", "wrong_n", "unknown_n")] == [2, 1, 3, 1]
    assert [got[k] for k in ("right_refined", "partial_refined", "wrong_refined")] == [1, 1, 1]
    assert round(got["hard_error"], 6) == round(3 / 7, 6) and round(got["soft_refined_error"], 6) == round(2 / 3, 6)
    empty = model.validation_report(predicted.limit(0), truth, {}).first()
    assert empty["right_n"] == 0 and empty["hard_error"] is None


def test_few_values_has_a_bound(spark):
    rows = spark.createDataFrame([(3,), (1,), (3,)], "k long")
    assert fn.few_values(rows, "k", 2) == [1, 3] and fn.few_values(rows.limit(0), "k") == []
    with pytest.raises(ValueError):
        fn.few_values(rows, "k", 1)


def test_best_of_totals_that_differ_each_time_they_are_computed(spark):
    """As sums of doubles do whose terms arrive in another order."""
    noise = F.udf(lambda: 100 + random.random() * 1e-9, "double").asNondeterministic()
    totals = spark.range(200, numPartitions=4).select((F.col("id") % 100).alias("variant_id"), F.when(F.col("id") < 100, 1).otherwise(2).cast("long").alias("impl_id")).where("impl_id = variant_id % 2 + 1 or variant_id = 7")
    totals = totals.withColumn("time", F.when(F.col("variant_id") == 7, F.col("impl_id") * 10.0).otherwise(noise()))
    got = {r["criterion"]: r["variant_id"] for r in model.interesting(totals).collect()}
    assert got == {"best 1": 0, "worst 1": 0, "best 2": 1, "worst 2": 7, "ratio": 7, "deviation": 7}
    assert {r["criterion"]: r["variant_id"] for r in model.interesting(totals.limit(0)).collect()} == {"ratio": None, "deviation": None}


def test_optimum_of_a_variant_without_core_steps(spark):
    steps = spark.createDataFrame([(1, 0, 1, 4.0), (1, 0, 3, 1.0), (1, 1, 3, 2.0), (2, 0, 3, 5.0), (3, 0, 9, 6.0)], "variant_id long, step_id long, impl_id long, avg_time double")
    impls = spark.createDataFrame([(1, "Core"), (3, "Derived")], "impl_id long, type string")
    totals = warehouse.impl_totals(steps, impls)
    assert sorted(map(tuple, totals.where("impl_id < 0").collect()), key=lambda r: r[:2]) == [(1, -2, 4.0), (1, -1, 4.0), (2, -1, None), (3, -1, None)]
    assert {tuple(r) for r in model.relative_to_optimal(totals).where("impl_id >= 0").collect()} == {(1, 1, 1.0), (1, 3, 0.75)}
    assert {r["impl_id"] for r in model.evaluate(totals).collect()} == {-2, -1, 1, 3}
