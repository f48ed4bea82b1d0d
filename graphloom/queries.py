"""The library's queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import functions as fn
from graphloom.operators import generate, relational
from graphloom.operators.graph import Graph, crossover, summary
from graphloom.operators.order import counted, numbered, top_share
from graphloom.plans import model, tables, warehouse
from graphloom.plans.lab import Lab, sql
from graphloom.sources import edgelist, logs
from graphloom.streaming import classify_properties, ingest_timings, map_rows, retry

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

ROOT, SEED = 1, 42
#: A fixed tree over step_id and graph_id; answers below 0 name a set that the tree could not tell apart.
TREE = [
    model.TreeNode(2.0, "step_id", 1, 2), model.TreeNode(10.0, "graph_id", 3, 4), model.TreeNode(4.0, "step_id", 5, 6),
    model.TreeNode(0, "", -1, 1), model.TreeNode(0, "", -1, 2), model.TreeNode(0, "", -1, -2), model.TreeNode(0, "", -1, 3),
]
SETS = {2: [1, 2]}


def query(oracle: str | None = None, recursive: bool = False):
    """Registers a function of a Lab under its name."""

    def register(f: Callable[[Lab], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Lab(spark, sf_dir))
        if oracle:
            _SQL[f.__name__] = sql(oracle, recursive)
        return f

    return register


def _graph(lab: Lab) -> Graph:
    from graphloom.shared import written

    return Graph(written(lab.edges, "edges"), lab.vertices)


def _r(column: str, digits: int = 4):
    return F.round(column, digits).alias(column)


# Sources and sinks


@query("SELECT id, coalesce(sum(d) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, d AS degree FROM (SELECT v.id, count(e.src) AS d FROM vertices v LEFT JOIN edges e ON e.src = v.id GROUP BY v.id)")
def s3_csr(lab: Lab) -> DataFrame:
    return _graph(lab).csr().select("id", F.col("first").cast("long").alias("first"), "degree")


@query("SELECT max(greatest(src, dst)) + 1 AS vertices, count(*) AS edges, false AS undirected FROM edges")
def s4_counts(lab: Lab) -> DataFrame:
    return Graph.of_edges(lab.edges).counts()


def _edge_text(lab: Lab) -> DataFrame:
    return lab.edges.select(F.concat(F.lit("  "), F.col("src"), F.lit("\t "), F.col("dst")).alias("value")).union(lab.spark.createDataFrame([("# comment",), ("% asym",), ("",)], "value string"))


@query("SELECT src, dst FROM edges")
def s5_parse_edges(lab: Lab) -> DataFrame:
    return edgelist.parse_pairs(_edge_text(lab)).select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"))


_NAMES = "names AS (SELECT token, row_number() OVER (ORDER BY p, token) - 1 AS id FROM (SELECT p_brand AS token, min(p_partkey) AS p FROM part GROUP BY p_brand))"


def _names(lab: Lab) -> DataFrame:
    return edgelist.first_seen(lab.table("part").select(F.col("p_brand").alias("token"), F.col("p_partkey").alias("pos")))


@query(f"{_NAMES} SELECT token, id FROM names")
def s6_dictionary(lab: Lab) -> DataFrame:
    return _names(lab)


@query(f"{_NAMES} SELECT id, token FROM names")
def s7_lookup(lab: Lab) -> DataFrame:
    wanted = _names(lab).select("id")
    return edgelist.lookup(wanted, _names(lab)).select("id", "token")


@query(f"{_NAMES} SELECT p.p_partkey AS part, n.id FROM part p JOIN names n ON n.token = p.p_brand")
def s7_reverse_lookup(lab: Lab) -> DataFrame:
    rows = lab.table("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("token"))
    return edgelist.lookup(rows, _names(lab), reverse=True).select("part", "id")


@query(
    "SELECT 0::BIGINT AS line_no, '%%MatrixMarket matrix coordinate real general' AS line UNION ALL SELECT 1, v || ' ' || v || ' ' || e FROM (SELECT (SELECT count(*) FROM vertices) AS v, (SELECT count(*) FROM edges) AS e)"
    " UNION ALL SELECT row_number() OVER (ORDER BY src, dst) + 1, (src + 1) || ' ' || (dst + 1) || ' 1.0' FROM edges"
)
def s8_matrix_market(lab: Lab) -> DataFrame:
    return edgelist.matrix_market(_graph(lab), weights=True)


@query("SELECT 0::BIGINT AS line_no, (SELECT count(*) FROM vertices) || ' ' || (SELECT count(*) FROM edges) AS line UNION ALL SELECT row_number() OVER (ORDER BY src, dst), src || chr(9) || dst FROM edges")
def s9_edge_list(lab: Lab) -> DataFrame:
    return edgelist.edge_lines(_graph(lab))


@query("SELECT v.id, coalesce(string_agg(CAST(e.dst AS VARCHAR), ' ' ORDER BY e.dst), '') AS neighbours FROM vertices v LEFT JOIN edges e ON e.src = v.id GROUP BY v.id")
def s11_adjacency(lab: Lab) -> DataFrame:
    return _graph(lab).adjacency().select("id", F.array_join("neighbours", " ").alias("neighbours"))


@query("SELECT variant_id, step_id, 'impl' || impl_id AS name, CAST(min_time AS DOUBLE) AS min_time, CAST(max_time AS DOUBLE) AS max_time FROM step_fact")
def s12_timings(lab: Lab) -> DataFrame:
    line = F.concat(F.col("step_id"), F.lit(":impl"), F.col("impl_id"), F.lit(":"), F.format_number("min_time", 0), F.lit(" 1.5 "), F.format_number("max_time", 0), F.lit(" 0.25"))
    return logs.parse_timings(lab.steps.select("variant_id", line.alias("value"))).where("ok").select("variant_id", "step_id", "name", "min_time", "max_time")


_LOG = "log AS (SELECT variant_id, step_id, impl_id, CASE impl_id WHEN 1 THEN 'graph' WHEN 2 THEN 'step' ELSE 'prediction' END AS kind, CAST(max_time AS DOUBLE) AS number FROM step_fact)"


def _property_rows(lab: Lab) -> DataFrame:
    i, s, m = F.col("impl_id"), F.col("step_id"), F.col("max_time")
    line = F.when(i == 1, F.concat_ws(":", F.lit("graph"), F.lit("size"), m)).when(i == 2, F.concat_ws(":", F.lit("step"), s, F.lit("front"), m)).otherwise(F.concat_ws(":", F.lit("prediction"), s, m))
    return logs.parse_properties(lab.steps.select("variant_id", line.alias("value"))).drop("value")


@query(f"{_LOG} SELECT variant_id, kind, CASE WHEN kind <> 'graph' THEN step_id ELSE -1 END AS step_id, CASE kind WHEN 'graph' THEN 'size' WHEN 'step' THEN 'front' END AS name, number FROM log")
def s13_properties(lab: Lab) -> DataFrame:
    return _property_rows(lab).select("variant_id", "kind", F.coalesce("step_id", F.lit(-1).cast("long")).alias("step_id"), "name", "number")


@query("SELECT graph_id, CAST(graph_id * 10 AS DOUBLE) AS avg_time, 0.0::DOUBLE AS min_time, 0.0::DOUBLE AS max_time, 0.0::DOUBLE AS std_dev FROM graph_dim WHERE graph_id % 2 = 0")
def s14_external_results(lab: Lab) -> DataFrame:
    name = F.when(F.col("graph_id") % 2 == 0, F.col("name")).otherwise(F.lit("nowhere"))
    lines = lab.graphs.select(F.concat_ws(":", name, F.col("dataset_id"), F.col("graph_id") * 10).alias("value"))
    return logs.parse_external(lines, lab.graphs)[0]


@query("SELECT run_id, variant_id, impl_id, total_time FROM run_fact WHERE validated AND impl_id IN (1, 3) ORDER BY total_time DESC, run_id, impl_id LIMIT 50 OFFSET 10")
def s15_table_scan(lab: Lab) -> DataFrame:
    return lab.runs.where(F.col("validated") & F.col("impl_id").isin(1, 3)).orderBy(F.desc("total_time"), "run_id", "impl_id").offset(10).limit(50).select("run_id", "variant_id", "impl_id", "total_time")


@query("SELECT c_custkey AS variant_id, CAST(c_nationkey + 100 AS BIGINT) AS graph_id FROM customer")
def s16_import(lab: Lab) -> DataFrame:
    there = lab.graphs.withColumn("graph_id", F.col("graph_id") + 100)
    moved, _ = tables.translate_ids(lab.variants.select("variant_id", "graph_id"), "graph_id", lab.graphs, there, ["name", "dataset_id"], "graph_id")
    return moved.select("variant_id", "graph_id")


@query("SELECT '{\"graph_id\":' || graph_id || ',\"name\":\"' || name || '\"}' AS line FROM graph_dim")
def s17_json_dump(lab: Lab) -> DataFrame:
    return logs.json_lines(lab.graphs.select("graph_id", "name"))


@query("SELECT s.variant_id, s.step_id, max(avg_time) FILTER (impl_id = 1) AS impl_1, max(avg_time) FILTER (impl_id = 2) AS impl_2, max(avg_time) FILTER (impl_id = 3) AS impl_3 FROM step_fact s JOIN variant_dim v USING (variant_id) WHERE v.config_name = 'BUILDING' GROUP BY ALL")
def s18_q8_step_heatmap(lab: Lab) -> DataFrame:
    return warehouse.step_heatmap(lab.steps, lab.variants, lab.impls, "BUILDING")


@query("SELECT variant_id, avg(total_time) FILTER (impl_id = 1) AS push, avg(total_time) FILTER (impl_id = 2) AS pull, avg(total_time) FILTER (impl_id = 3) AS switch FROM run_fact GROUP BY variant_id")
def s19_bar_series(lab: Lab) -> DataFrame:
    return lab.runs.join(lab.impls, "impl_id").groupBy("variant_id").pivot("name", ["push", "pull", "switch"]).agg(F.avg("total_time"))


@query(
    "SELECT variant_id, count(*) AS lines, CAST(sum(('0x' || substr(md5(run_id || ':' || impl_id || ':' || total_time), 1, 12))::BIGINT) AS VARCHAR) AS digest FROM run_fact GROUP BY variant_id"
)
def s22_result_digest(lab: Lab) -> DataFrame:
    return logs.digest_of_lines(lab.runs.withColumn("line", F.concat_ws(":", "run_id", "impl_id", "total_time")), "line", ["variant_id"])


# Filters


@query("SELECT run_id, impl_id FROM run_fact WHERE impl_id IN (1, 2) AND validated IN (true)")
def f1_equality_filter(lab: Lab) -> DataFrame:
    return lab.runs.where(relational.equals_any({"impl_id": [1, 2], "validated": [True], "run_id": []})).select("run_id", "impl_id")


@query("SELECT graph_id, name FROM graph_dim WHERE contains(lower(name), 'ion_1')")
def f2_substring_filter(lab: Lab) -> DataFrame:
    return lab.graphs.where(relational.contains("name", "ion_1")).select("graph_id", "name")


@query("SELECT graph_id, name FROM graph_dim WHERE starts_with(lower(name), 'nation_2')")
def f3_prefix_filter(lab: Lab) -> DataFrame:
    return lab.graphs.where(relational.starts_with("name", "nation_2")).select("graph_id", "name")


@query("SELECT run_id, impl_id, total_time FROM run_fact WHERE ts < TIMESTAMP '1996-01-01' OR (impl_id = 3 AND ts > TIMESTAMP '1996-01-01')")
def f5_visible_runs(lab: Lab) -> DataFrame:
    rows = lab.runs.withColumn("impl_ts", F.when(F.col("impl_id") == 3, F.col("ts")))
    return rows.where(F.coalesce(relational.visible("ts", "impl_ts", "1996-01-01 00:00:00", newer_impls=True), F.lit(False))).select("run_id", "impl_id", "total_time")


@query("SELECT variant_id FROM variant_dim WHERE variant_id BETWEEN 5 AND 10 OR variant_id = 13 OR variant_id BETWEEN 17 AND 20")
def f7_intervals(lab: Lab) -> DataFrame:
    return lab.variants.where(fn.in_intervals("variant_id", "5-10,13,17-20")).select("variant_id")


@query("SELECT graph_id, count(*) AS n FROM edges e JOIN (SELECT id, id % 25 AS graph_id FROM vertices) v ON v.id = e.src GROUP BY graph_id HAVING count(*) >= 1800 OR count(*) >= 10 AND graph_id < 5")
def f10_edge_count_filter(lab: Lab) -> DataFrame:
    per = lab.edges.groupBy((F.col("src") % 25).alias("graph_id")).agg(F.count("*").alias("n"))
    return per.where((F.col("n") >= 1800) | (F.col("n") >= 10) & (F.col("graph_id") < 5))


@query("SELECT a.variant_id, a.step_id FROM (SELECT variant_id, step_id, CASE WHEN impl_id = 3 THEN NULL ELSE impl_id END AS k FROM step_fact) a WHERE a.k IS NOT DISTINCT FROM NULL")
def f11_null_safe(lab: Lab) -> DataFrame:
    rows = lab.steps.withColumn("k", F.when(F.col("impl_id") != 3, F.col("impl_id")))
    return rows.where(F.col("k").eqNullSafe(F.lit(None))).select("variant_id", "step_id")


@query("SELECT impl_id, CASE impl_id WHEN 2 THEN 'Pulling' WHEN 1 THEN 'push' ELSE 'Switch' END AS shown FROM impl_dim")
def f13_f15_display_names(lab: Lab) -> DataFrame:
    rows = lab.impls.withColumn("pretty", F.when(F.col("impl_id") == 3, F.lit("Switch")))
    return rows.select("impl_id", relational.display_name("pretty", "name", {2: "Pulling"}, "impl_id").alias("shown"))


# Joins


@query("SELECT r.run_id, i.name AS impl, v.config_name, g.name AS graph, d.name AS dataset, r.total_time FROM run_fact r JOIN impl_dim i USING (impl_id) JOIN variant_dim v USING (variant_id) JOIN graph_dim g USING (graph_id) JOIN dataset_dim d USING (dataset_id)")
def j1_multi_way(lab: Lab) -> DataFrame:
    joined = lab.runs.join(lab.impls.select("impl_id", F.col("name").alias("impl")), "impl_id").join(lab.variants, "variant_id")
    joined = joined.join(lab.graphs.select("graph_id", "dataset_id", F.col("name").alias("graph")), "graph_id").join(lab.datasets.select("dataset_id", F.col("name").alias("dataset")), "dataset_id")
    return joined.select("run_id", "impl", "config_name", "graph", "dataset", "total_time")


@query("SELECT v.variant_id, coalesce(r.run_id, -1) AS run_id FROM variant_dim v LEFT JOIN (SELECT * FROM run_fact WHERE impl_id = 1) r USING (variant_id)")
def j3_left_outer(lab: Lab) -> DataFrame:
    return lab.variants.join(lab.runs.where("impl_id = 1"), "variant_id", "left").select("variant_id", F.coalesce("run_id", F.lit(-1).cast("long")).alias("run_id"))


@query("SELECT variant_id FROM variant_dim WHERE variant_id NOT IN (SELECT variant_id FROM run_fact WHERE NOT validated)")
def j4_left_anti(lab: Lab) -> DataFrame:
    return lab.variants.join(lab.runs.where("not validated"), "variant_id", "left_anti").select("variant_id")


@query("m AS (SELECT impl_id, avg(total_time) AS a FROM run_fact GROUP BY impl_id) SELECT r.run_id, r.impl_id FROM run_fact r JOIN m ON m.impl_id = r.impl_id AND r.total_time > 4 * m.a")
def j6_residual_condition(lab: Lab) -> DataFrame:
    runs = lab.runs
    means = runs.groupBy(F.col("impl_id").alias("i")).agg(F.avg("total_time").alias("a"))
    return runs.join(means, (F.col("i") == F.col("impl_id")) & (F.col("total_time") > 4 * F.col("a"))).select("run_id", "impl_id")


@query("SELECT variant_id FROM variant_dim WHERE variant_id IN (SELECT variant_id FROM run_fact WHERE NOT validated)")
def j7_left_semi(lab: Lab) -> DataFrame:
    return lab.variants.join(lab.runs.where("not validated"), "variant_id", "left_semi").select("variant_id")


@query("SELECT DISTINCT e.dst AS id FROM edges e JOIN vertices v ON v.id = e.src")
def j11_expand(lab: Lab) -> DataFrame:
    return lab.edges.join(lab.vertices, F.col("id") == F.col("src"), "left_semi").select(F.col("dst").alias("id")).distinct()


# Aggregates


@query("SELECT impl_id, coalesce(sum(CAST(total_time AS DOUBLE)) FILTER (run_id < 0), 0.0) AS nothing, coalesce(sum(CAST(total_time AS DOUBLE)), 0.0) AS everything FROM run_fact GROUP BY impl_id")
def a3_total(lab: Lab) -> DataFrame:
    return lab.runs.groupBy("impl_id").agg(fn.total(F.when(F.col("run_id") < 0, F.col("total_time"))).alias("nothing"), fn.total("total_time").alias("everything"))


@query("SELECT variant_id, arg_min(impl_id, row(avg_time IS NULL, avg_time, max_time IS NULL, max_time, impl_id)) AS best_impl FROM step_fact GROUP BY variant_id")
def a9_k4_min_key(lab: Lab) -> DataFrame:
    return warehouse.best_impl(lab.steps)


@query("SELECT variant_id, CASE WHEN count(DISTINCT impl_id) = 1 THEN max(impl_id) ELSE -1 END AS only_impl FROM run_fact GROUP BY variant_id")
def a10_k5_check_unique(lab: Lab) -> DataFrame:
    return lab.runs.groupBy("variant_id").agg(F.coalesce(fn.check_unique("impl_id"), F.lit(-1).cast("long")).alias("only_impl"))


@query("SELECT coalesce(round(avg(length(name))), 0) AS mean_length, max(length(name)) AS max_length FROM graph_dim")
def a13_lengths(lab: Lab) -> DataFrame:
    return lab.graphs.agg(F.coalesce(F.round(F.avg(F.length("name"))), F.lit(0.0)).alias("mean_length"), F.max(F.length("name")).cast("long").alias("max_length"))


@query("SELECT dataset_id, string_agg(name, ',' ORDER BY name) AS names FROM graph_dim GROUP BY dataset_id")
def a14_group_concat(lab: Lab) -> DataFrame:
    return lab.graphs.groupBy("dataset_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@query("SELECT impl_id, min(total_time) AS least, round(avg(total_time), 4) AS mean, max(total_time) AS most, round(stddev_pop(total_time), 2) AS sd FROM run_fact GROUP BY impl_id")
def a17_population_stats(lab: Lab) -> DataFrame:
    return lab.runs.groupBy("impl_id").agg(F.min("total_time").alias("least"), F.round(F.avg("total_time"), 4).alias("mean"), F.max("total_time").alias("most"), F.round(F.stddev_pop("total_time"), 2).alias("sd"))


@query("SELECT variant_id, impl_id, min(total_time) AS least, round(avg(total_time), 4) AS mean, max(total_time) AS most, round(coalesce(stddev_samp(total_time), 0), 2) AS sd FROM run_fact GROUP BY variant_id, impl_id")
def a18_timer_stats(lab: Lab) -> DataFrame:
    return lab.runs.groupBy("variant_id", "impl_id").agg(F.min("total_time").alias("least"), F.round(F.avg("total_time"), 4).alias("mean"), F.max("total_time").alias("most"), F.round(F.coalesce(F.stddev_samp("total_time"), F.lit(0.0)), 2).alias("sd"))


# Windows


@query("SELECT variant_id, row_number() OVER (ORDER BY variant_id) AS rn FROM variant_dim")
def w1_row_number(lab: Lab) -> DataFrame:
    return numbered(lab.variants.select("variant_id"), ["variant_id"])


@query("SELECT variant_id, step_id, impl_id, row_number() OVER (PARTITION BY variant_id, step_id ORDER BY avg_time, impl_id) AS place, count(*) OVER (PARTITION BY variant_id, step_id) AS n FROM step_fact")
def w3_w4_partition_windows(lab: Lab) -> DataFrame:
    by = Window.partitionBy("variant_id", "step_id")
    return lab.steps.select("variant_id", "step_id", "impl_id", F.row_number().over(by.orderBy("avg_time", "impl_id")).cast("long").alias("place"), F.count("*").over(by).alias("n"))


@query("SELECT variant_id, CAST(sum(c) AS BIGINT) AS transitions FROM (SELECT variant_id, CASE WHEN row_number() OVER w = 1 OR b IS DISTINCT FROM lag(b) OVER w THEN 1 ELSE 0 END AS c FROM (SELECT variant_id, step_id, arg_min(impl_id, row(avg_time, impl_id)) AS b FROM step_fact GROUP BY ALL) WINDOW w AS (PARTITION BY variant_id ORDER BY step_id)) GROUP BY variant_id")
def w7_k7_transitions(lab: Lab) -> DataFrame:
    best = lab.steps.groupBy("variant_id", "step_id").agg(fn.min_key("impl_id", "avg_time").alias("b"))
    return best.withColumn("c", fn.count_transitions("b", ["variant_id"], ["step_id"])).groupBy("variant_id").agg(F.sum("c").alias("transitions"))


@query("SELECT variant_id FROM (SELECT variant_id, row_number() OVER (ORDER BY md5('42:1:' || variant_id), variant_id) AS rn, count(*) OVER () AS n FROM variant_dim) WHERE rn <= floor(0.5 * n)")
def w8_k6_sample(lab: Lab) -> DataFrame:
    return fn.select_sample(lab.variants, "variant_id", SEED, 1, 0.5).where("keep").select("variant_id")


_PREDICTED = (
    "raw AS (SELECT DISTINCT s.variant_id, s.step_id, v.graph_id FROM step_fact s JOIN variant_dim v USING (variant_id)),"
    f"ans AS (SELECT variant_id, step_id, {model.tree_sql(TREE)} AS raw FROM raw),"
    "res AS (SELECT variant_id, step_id, raw, CASE WHEN raw >= 0 THEN raw END AS answer FROM ans),"
    "pred AS (SELECT variant_id, step_id, raw, answer, coalesce(last_value(answer IGNORE NULLS) OVER (PARTITION BY variant_id ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS impl FROM res)"
)


def _steps_with_graph(lab: Lab) -> DataFrame:
    return lab.steps.select("variant_id", "step_id").distinct().join(lab.variants.select("variant_id", "graph_id"), "variant_id")


@query(f"{_PREDICTED} SELECT variant_id, step_id, coalesce(answer, -1) AS answer, impl FROM pred")
def w10_m1_m3_predict(lab: Lab) -> DataFrame:
    return model.predict(_steps_with_graph(lab), TREE, 3, model.resolve_sets(SETS, "none")).select("variant_id", "step_id", F.coalesce("answer", F.lit(-1).cast("long")).alias("answer"), "impl")


# Sorting


@query("SELECT variant_id, graph_id, config_name FROM variant_dim WHERE config_name = 'MACHINERY' ORDER BY graph_id DESC, variant_id LIMIT 20 OFFSET 5")
def o2_o3_q13_listing(lab: Lab) -> DataFrame:
    return relational.list_entities(lab.variants, {"config_name": ["MACHINERY"]}, sort=[("graph_id", False)], key="variant_id", limit=20, offset=5)


@query("SELECT graph_id, name FROM (SELECT *, row_number() OVER (ORDER BY md5('42:0:' || graph_id), graph_id) AS rn FROM graph_dim) WHERE rn <= 10")
def o4_m14_random_split(lab: Lab) -> DataFrame:
    return relational.random_split(lab.graphs.select("graph_id", "name"), "graph_id", SEED, 10)[0]


@query("SELECT id, row_number() OVER (ORDER BY d DESC, id) - 1 AS new_id FROM (SELECT v.id, count(e.src) AS d FROM vertices v LEFT JOIN edges e ON e.src = v.id GROUP BY v.id)")
def o5_g9_reorder_best(lab: Lab) -> DataFrame:
    return _graph(lab).reorder("out")


_WORST = (
    "r AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) - 1 AS a, count(*) OVER () AS v, CAST(ceil(count(*) OVER () / 32.0) AS BIGINT) AS w FROM (SELECT v.id, count(e.dst) AS d FROM vertices v LEFT JOIN edges e ON e.dst = v.id GROUP BY v.id)),"
    "g AS (SELECT *, CASE WHEN a < w THEN a WHEN a >= v - w THEN a - (v - w) ELSE (a - w) // 30 END AS grp, CASE WHEN a < w THEN 0 WHEN a >= v - w THEN 1 ELSE 2 + (a - w) % 30 END AS off FROM r)"
)


@query(f"{_WORST} SELECT id, CAST(grp * 2 + least(grp * 30, v - 2 * w) + off AS BIGINT) AS new_id FROM g")
def o6_g9_reorder_worst(lab: Lab) -> DataFrame:
    return _graph(lab).reorder("in", worst=True)


@query("(SELECT 'first' AS side, graph_id, name FROM graph_dim ORDER BY name, graph_id LIMIT 3) UNION ALL (SELECT 'last', graph_id, name FROM graph_dim ORDER BY name DESC, graph_id DESC LIMIT 3)")
def o9_ends(lab: Lab) -> DataFrame:
    return relational.ends(lab.graphs.select("graph_id", "name"), "name", "graph_id")


# Sets


@query("(SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) EXCEPT (SELECT src, dst FROM edges INTERSECT SELECT dst, src FROM edges)")
def u1_symmetric_difference(lab: Lab) -> DataFrame:
    return relational.symmetric_difference(lab.edges, _graph(lab).reversed.edges)


@query(
    "one AS (SELECT src, dst FROM edges), two AS (SELECT dst AS src, src AS dst FROM edges), mut AS (SELECT id AS src, id + 1 AS dst FROM vertices),"
    " kept AS (SELECT src, dst FROM one WHERE dst <= 900 UNION SELECT src, dst FROM two WHERE dst > 900 UNION (SELECT src, dst FROM one INTERSECT SELECT src, dst FROM two))"
    " SELECT src, dst FROM ((SELECT * FROM kept EXCEPT SELECT * FROM mut) UNION (SELECT * FROM mut EXCEPT SELECT * FROM kept))"
)
def u3_g13_crossover(lab: Lab) -> DataFrame:
    g, turned = _graph(lab), lab.vertices.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return crossover(g, g.reversed, "point", 900, mutations=turned).edges


# Functions


@query("SELECT s.variant_id, s.step_id, i.impl_id, max(f.avg_time) AS time FROM (SELECT DISTINCT variant_id, step_id FROM step_fact) s CROSS JOIN impl_dim i LEFT JOIN step_fact f ON f.variant_id = s.variant_id AND f.step_id = s.step_id AND f.impl_id = i.impl_id GROUP BY s.variant_id, s.step_id, i.impl_id")
def k1_k3_dense_vectors(lab: Lab) -> DataFrame:
    made = fn.dense_vector(lab.impls, lab.steps, ["variant_id", "step_id"], "impl_id", "avg_time", float("inf"))
    time = F.when(F.col("x.value") < float("inf"), F.col("x.value"))
    return made.select("variant_id", "step_id", F.explode("vector").alias("x")).select("variant_id", "step_id", F.col("x.key").alias("impl_id"), time.alias("time"))


@query("SELECT variant_id, round(sqrt(total_time), 6) AS root, printf('%.2f%%', 100 * CAST(impl_id AS DOUBLE) / 4) AS share, greatest(impl_id, 2) AS most, CAST(floor((sqrt(8 * CAST(run_id AS DOUBLE) + 1) - 1) / 2) AS BIGINT) AS tri FROM run_fact")
def k8_scalars(lab: Lab) -> DataFrame:
    return lab.runs.select("variant_id", F.round(F.sqrt("total_time"), 6).alias("root"), fn.percentage(F.col("impl_id") / 4).alias("share"), fn.greatest_or_null("impl_id", F.lit(2)).cast("long").alias("most"), fn.triangle_row("run_id").alias("tri"))


# Pipelines


@query(f"{_LOG} SELECT kind, CASE WHEN kind = 'graph' THEN 'unknown' WHEN step_id > 4 THEN 'out_of_range' ELSE 'ok' END AS state, count(*) AS n FROM log GROUP BY ALL")
def p10_property_states(lab: Lab) -> DataFrame:
    known = lab.spark.createDataFrame([("front",)], "property string")
    last = lab.variants.select("variant_id", F.lit(4).cast("long").alias("max_step"))
    return classify_properties(_property_rows(lab), known, last).groupBy("kind", "state").agg(F.count("*").alias("n"))


@query("SELECT run_id, run_id % 3 <> 0 AS validated FROM (SELECT DISTINCT run_id FROM run_fact) WHERE run_id % 5 <> 0 AND run_id % 7 <> 0")
def p11_ingest_timings(lab: Lab) -> DataFrame:
    runs = lab.runs.select("run_id", "variant_id").distinct()
    runs = runs.select("*", F.when(F.col("run_id") % 3 != 0, F.col("variant_id").cast("string")).otherwise(F.lit("x")).alias("result"), F.when(F.col("run_id") % 5 != 0, F.lit("c1")).otherwise(F.lit("c0")).alias("version"), F.lit(6).cast("long").alias("max_step"))
    timings = runs.select("run_id", F.when(F.col("run_id") % 7 != 0, 6).otherwise(7).cast("long").alias("step_id"))
    expected = lab.variants.select("variant_id", F.col("variant_id").cast("string").alias("result"))
    return ingest_timings(runs, timings, expected, "c1")[0].select("run_id", "validated")


@query("SELECT variant_id, variant_id % 6 + CASE WHEN variant_id % 2 = 0 AND variant_id % 3 <> 0 THEN 1 ELSE 0 END AS retry_count FROM variant_dim WHERE variant_id % 6 + CASE WHEN variant_id % 2 = 0 AND variant_id % 3 <> 0 THEN 1 ELSE 0 END < 5")
def p4_retry(lab: Lab) -> DataFrame:
    v = lab.variants.select("variant_id", (F.col("variant_id") % 6).alias("retry_count"))
    return retry(v, v.where("variant_id % 2 = 0"), v.where("variant_id % 3 = 0"))


@query("SELECT graph_id, length(name) AS size FROM graph_dim WHERE graph_id % 4 <> 0")
def p3_parallel_map(lab: Lab) -> DataFrame:
    def work(row: dict) -> dict:
        if row["graph_id"] % 4 == 0:
            raise ValueError("dropped")
        return {"graph_id": row["graph_id"], "size": len(row["name"])}

    return map_rows(lab.graphs.select("graph_id", "name"), work, "graph_id long, size long")


# Warehouse

_BEST = "best AS (SELECT s.variant_id, s.step_id, arg_min(s.impl_id, row(s.avg_time IS NULL, s.avg_time, s.max_time, s.min_time, s.impl_id)) FILTER (i.type = 'Core') AS best_impl, min(s.avg_time) FILTER (i.type = 'Core') AS best_time FROM step_fact s JOIN impl_dim i ON i.impl_id = s.impl_id GROUP BY s.variant_id, s.step_id HAVING count(*) = (SELECT count(*) FROM impl_dim))"


@query(f"{_BEST} SELECT * FROM best")
def q1_best_per_step(lab: Lab) -> DataFrame:
    return warehouse.best_per_step(lab.steps, lab.impls)


@query(f"{_BEST} SELECT b.variant_id, b.step_id, b.best_impl, b.best_impl - 1 AS best_idx, s.impl_id, s.avg_time AS time, CAST(p.value AS DOUBLE) AS prop FROM best b JOIN step_fact s USING (variant_id, step_id) JOIN (SELECT variant_id, step_id, sum(max_time) AS value FROM step_fact GROUP BY ALL) p USING (variant_id, step_id)")
def q1_step_info(lab: Lab) -> DataFrame:
    props = lab.steps.groupBy("variant_id", "step_id").agg(F.sum("max_time").alias("value")).withColumn("prop_id", F.lit(1).cast("long"))
    info = warehouse.step_info(lab.steps, lab.impls, props)
    return info.select("variant_id", "step_id", "best_impl", "best_idx", F.col("props")[0]["value"].alias("prop"), F.explode("timings").alias("t")).select("variant_id", "step_id", "best_impl", "best_idx", F.col("t.key").alias("impl_id"), F.col("t.value").alias("time"), "prop")


@query("SELECT v.variant_id, v.graph_id FROM variant_dim v JOIN graph_dim g USING (graph_id) WHERE g.dataset_id IN (1, 3) AND v.config_name = 'BUILDING'")
def q2_variants(lab: Lab) -> DataFrame:
    chosen = lab.graphs.where(F.col("dataset_id").isin(1, 3)).select("graph_id")
    return lab.variants.where("config_name = 'BUILDING'").join(chosen, "graph_id").select("variant_id", "graph_id")


@query(
    "least_step AS (SELECT s.variant_id, s.step_id, min(s.avg_time) AS m FROM step_fact s JOIN impl_dim i USING (impl_id) WHERE i.type = 'Core' GROUP BY ALL), opt AS (SELECT variant_id, sum(m) AS optimal FROM least_step GROUP BY variant_id),"
    " tot AS (SELECT r.variant_id, r.impl_id, avg(r.total_time) AS t FROM run_fact r JOIN impl_dim i USING (impl_id) WHERE i.type = 'Core' AND r.validated GROUP BY ALL)"
    " SELECT opt.variant_id, round(optimal, 4) AS optimal, round(min(t), 4) AS best_non_switching FROM opt LEFT JOIN tot USING (variant_id) GROUP BY opt.variant_id, optimal"
)
def q3_variant_info(lab: Lab) -> DataFrame:
    return warehouse.variant_info(lab.steps, lab.runs, lab.impls).select("variant_id", _r("optimal"), _r("best_non_switching"))


_DRAW = "row_number() OVER (ORDER BY md5('42:{0}:' || {1}), {1}) <= floor({2} * count(*) OVER ())"


@query(
    f"{_BEST}, b AS (SELECT best.*, v.graph_id, best.variant_id || ':' || best.step_id AS step_key FROM best JOIN variant_dim v USING (variant_id)),"
    f" g AS (SELECT graph_id, {_DRAW.format(1, 'graph_id', 0.8)} AS k FROM (SELECT DISTINCT graph_id FROM b)), v AS (SELECT variant_id, {_DRAW.format(2, 'variant_id', 0.5)} AS k FROM (SELECT DISTINCT variant_id FROM b)),"
    f" s AS (SELECT step_key, {_DRAW.format(3, 'step_key', 0.7)} AS k FROM (SELECT DISTINCT step_key FROM b))"
    " SELECT b.variant_id, b.step_id, b.graph_id, b.best_impl, b.best_time, g.k AND v.k AND s.k AS keep FROM b JOIN g USING (graph_id) JOIN v USING (variant_id) JOIN s USING (step_key)"
)
def q4_train_steps(lab: Lab) -> DataFrame:
    return warehouse.train_steps(lab.steps, lab.variants, lab.impls, SEED, 0.8, 0.5, 0.7).select("variant_id", "step_id", "graph_id", "best_impl", "best_time", "keep")


@query("SELECT impl_id, round(avg(avg_time), 4) AS mean, round(coalesce(sum(CAST(avg_time AS DOUBLE)), 0), 2) AS total, min(avg_time) AS least FROM step_fact GROUP BY impl_id")
def q5_impl_rank(lab: Lab) -> DataFrame:
    mean, total, least = (warehouse.impl_rank(lab.steps, "avg_time", r).withColumnRenamed("value", n) for r, n in (("avg", "mean"), ("total", "total"), ("min", "least")))
    return mean.join(total, "impl_id").join(least, "impl_id").select("impl_id", _r("mean"), _r("total", 2), "least")


@query("SELECT v.variant_id, v.graph_id, g.name AS graph, i.impl_id, t.time FROM variant_dim v JOIN graph_dim g USING (graph_id) CROSS JOIN impl_dim i LEFT JOIN (SELECT variant_id, impl_id, avg(total_time) AS time FROM run_fact GROUP BY ALL) t ON t.variant_id = v.variant_id AND t.impl_id = i.impl_id WHERE v.config_name = 'BUILDING'")
def q6_time_plot(lab: Lab) -> DataFrame:
    return warehouse.time_plot(lab.runs, lab.variants, lab.graphs, lab.impls, "BUILDING")


@query("m AS (SELECT step_id, impl_id, avg_time FROM step_fact WHERE variant_id = 7) SELECT s.step_id, i.impl_id, m.avg_time AS time FROM (SELECT DISTINCT step_id FROM m) s CROSS JOIN impl_dim i LEFT JOIN m ON m.step_id = s.step_id AND m.impl_id = i.impl_id")
def q7_level_plot(lab: Lab) -> DataFrame:
    return warehouse.level_plot(lab.steps, 7, lab.impls)


@query("SELECT v.variant_id, i.impl_id FROM variant_dim v CROSS JOIN impl_dim i LEFT JOIN run_fact r ON r.variant_id = v.variant_id AND r.impl_id = i.impl_id WHERE r.run_id IS NULL")
def q9_missing_runs(lab: Lab) -> DataFrame:
    return warehouse.missing_runs(lab.variants, lab.impls, lab.runs)


@query("SELECT v.variant_id, v.graph_id, count(*) AS unvalidated FROM run_fact r JOIN variant_dim v USING (variant_id) WHERE NOT r.validated GROUP BY ALL")
def q10_validation_variants(lab: Lab) -> DataFrame:
    return warehouse.validation_variants(lab.runs, lab.variants)


@query("SELECT variant_id, run_id, impl_id, name FROM run_fact JOIN impl_dim USING (impl_id) WHERE NOT validated")
def q11_validation_runs(lab: Lab) -> DataFrame:
    return warehouse.validation_runs(lab.runs, lab.impls)


@query(
    "tries AS (SELECT variant_id, count(*) FILTER (NOT validated) AS retry_count FROM run_fact GROUP BY variant_id) SELECT v.variant_id, i.impl_id FROM variant_dim v JOIN tries t USING (variant_id) CROSS JOIN impl_dim i"
    " LEFT JOIN (SELECT DISTINCT variant_id, impl_id FROM run_fact WHERE validated) r ON r.variant_id = v.variant_id AND r.impl_id = i.impl_id WHERE r.impl_id IS NULL AND t.retry_count < 3"
)
def q9_missing_retries(lab: Lab) -> DataFrame:
    """Missing are those without a validated run; unvalidated ones count as tries."""
    tries = lab.runs.groupBy("variant_id").agg(F.count_if(~F.col("validated")).alias("retry_count"))
    return warehouse.missing_runs(lab.variants.join(tries, "variant_id"), lab.impls, lab.runs.where("validated"), retries=3)


@query(
    "SELECT v.variant_id, i.impl_id, round(max(t.time), 4) AS time FROM (SELECT DISTINCT variant_id FROM step_fact) v CROSS JOIN impl_dim i"
    " LEFT JOIN (SELECT variant_id, impl_id, sum(avg_time) AS time FROM step_fact GROUP BY ALL) t ON t.variant_id = v.variant_id AND t.impl_id = i.impl_id GROUP BY ALL"
)
def q3_variant_vectors(lab: Lab) -> DataFrame:
    made = warehouse.variant_vectors(lab.steps, lab.impls).select("variant_id", F.explode("timings").alias("x"))
    return made.select("variant_id", F.col("x.key").alias("impl_id"), F.round(F.when(F.col("x.value") < float("inf"), F.col("x.value")), 4).alias("time"))


@query("SELECT DISTINCT config_name FROM variant_dim WHERE config_name ILIKE 'm%'")
def q12_distinct_field(lab: Lab) -> DataFrame:
    return warehouse.distinct_field(lab.variants, "config_name", "m")


# Models


@query(
    f"{_PREDICTED}, tot AS (SELECT variant_id, impl_id, sum(avg_time) AS time FROM step_fact GROUP BY ALL),"
    " opt AS (SELECT variant_id, sum(m) AS time FROM (SELECT variant_id, step_id, min(avg_time) FILTER (impl_id < 3) AS m FROM step_fact GROUP BY ALL) GROUP BY variant_id),"
    " one AS (SELECT variant_id, min(time) AS time FROM tot WHERE impl_id < 3 GROUP BY variant_id),"
    " p AS (SELECT variant_id, sum(avg_time) AS time FROM pred JOIN step_fact s USING (variant_id, step_id) WHERE s.impl_id = pred.impl GROUP BY variant_id)"
    " SELECT variant_id, impl_id, round(time, 4) AS time FROM (SELECT variant_id, impl_id, time FROM tot UNION ALL SELECT variant_id, -1, time FROM opt UNION ALL SELECT variant_id, -2, time FROM one UNION ALL SELECT variant_id, -3, time FROM p)"
)
def m4_m6_totals(lab: Lab) -> DataFrame:
    return _totals(lab).select("variant_id", "impl_id", _r("time"))


def _totals(lab: Lab) -> DataFrame:
    predicted = model.predict(_steps_with_graph(lab), TREE, 3, model.resolve_sets(SETS, "none"))
    return warehouse.impl_totals(lab.steps, lab.impls).unionByName(model.predicted_totals(predicted, lab.steps, fn.FIRST_PREDICTOR))


@query(
    "tot AS (SELECT variant_id, impl_id, sum(avg_time) AS time FROM step_fact GROUP BY ALL),"
    " opt AS (SELECT variant_id, sum(m) AS base FROM (SELECT variant_id, step_id, min(avg_time) FILTER (impl_id < 3) AS m FROM step_fact GROUP BY ALL) GROUP BY variant_id HAVING sum(m) > 0),"
    " rel AS (SELECT impl_id, time, base, time / base AS rel FROM tot JOIN opt USING (variant_id))"
    " SELECT impl_id, round(sum(time) / sum(base), 6) AS total_ratio, round(avg(rel), 6) AS avg_rel, count(*) FILTER (rel < 2) AS lt2, count(*) FILTER (rel > 5) AS gt5, count(*) FILTER (rel > 20) AS gt20, round(max(rel), 4) AS max_rel FROM rel GROUP BY impl_id"
)
def m5_evaluate(lab: Lab) -> DataFrame:
    found = model.evaluate(warehouse.impl_totals(lab.steps, lab.impls)).where("impl_id >= 0")
    return found.select("impl_id", _r("total_ratio", 6), _r("avg_rel", 6), "lt2", "gt5", "gt20", _r("max_rel"))


@query(
    f"{_PREDICTED}, {_BEST}, j AS (SELECT CASE WHEN raw = best_impl THEN 'right' WHEN raw IS NULL THEN 'unknown' WHEN raw < 0 THEN CASE WHEN best_impl IN (1, 2) THEN 'partial' ELSE 'wrong' END ELSE 'wrong' END AS counter FROM pred JOIN best USING (variant_id, step_id))"
    " SELECT counter, count(*) AS value FROM j GROUP BY counter UNION ALL SELECT 'total', count(*) FROM j"
)
def m7_validate(lab: Lab) -> DataFrame:
    raw = _steps_with_graph(lab).withColumn("raw", model.tree_column(TREE))
    return model.validate(raw, warehouse.best_per_step(lab.steps, lab.impls), SETS)


@query(
    f"{_PREDICTED}, {_BEST}, j AS (SELECT CASE WHEN raw = -2 THEN 1 ELSE raw END AS said, raw = -2 AS refined, best_impl AS truth, raw = -2 AND best_impl IN (1, 2) AS among FROM pred JOIN best USING (variant_id, step_id)),"
    " c AS (SELECT count(*) FILTER (said = truth) AS right_n, count(*) FILTER (said <> truth AND among) AS partial_n, count(*) FILTER (said <> truth AND NOT among) AS wrong_n, 0::BIGINT AS unknown_n,"
    " count(*) FILTER (refined AND said = truth) AS right_refined, count(*) FILTER (said <> truth AND among) AS partial_refined, 0::BIGINT AS wrong_refined FROM j)"
    " SELECT *, round(wrong_n / (right_n + partial_n + wrong_n), 6) AS hard_error, round((wrong_n + partial_n) / (right_n + partial_n + wrong_n), 6) AS soft_error,"
    " 0.0::DOUBLE AS hard_refined_error, round(partial_refined / nullif(right_refined + partial_refined, 0), 6) AS soft_refined_error FROM c"
)
def m7_refinements(lab: Lab) -> DataFrame:
    raw = _steps_with_graph(lab).withColumn("raw", model.tree_column(TREE))
    found = model.validation_report(raw, warehouse.best_per_step(lab.steps, lab.impls), SETS, model.resolve_sets(SETS, "firstinset"))
    return found.select(*found.columns[:7], *[_r(c, 6) for c in found.columns[7:]])


@query(
    "tot AS (SELECT variant_id, impl_id, sum(avg_time) AS time FROM step_fact GROUP BY ALL), base AS (SELECT variant_id, min(time) AS least, max(time) AS most, stddev_pop(time) AS sd, avg(time) AS mean FROM tot GROUP BY variant_id HAVING min(time) > 0),"
    " rel AS (SELECT t.variant_id, t.impl_id, time / least AS rel FROM tot t JOIN base USING (variant_id))"
    " SELECT 'best ' || impl_id AS criterion, arg_min(variant_id, row(rel, variant_id)) AS variant_id FROM rel GROUP BY impl_id UNION ALL SELECT 'worst ' || impl_id, arg_max(variant_id, row(rel, -variant_id)) FROM rel GROUP BY impl_id"
    " UNION ALL SELECT 'ratio', arg_max(variant_id, row(most / least, -variant_id)) FROM base UNION ALL SELECT 'deviation', arg_max(variant_id, row(sd / mean, -variant_id)) FROM base"
)
def m11_interesting(lab: Lab) -> DataFrame:
    return model.interesting(warehouse.impl_totals(lab.steps, lab.impls))


@query("SELECT impl_id, round(avg(pow((total_time - m) / s, 3)), 4) AS skewness, round(kurtosis_pop(total_time), 4) AS kurtosis FROM (SELECT impl_id, total_time, avg(total_time) OVER (PARTITION BY impl_id) AS m, stddev_pop(total_time) OVER (PARTITION BY impl_id) AS s FROM run_fact) GROUP BY impl_id")
def m11_shape(lab: Lab) -> DataFrame:
    return model.shape(lab.runs.withColumnRenamed("total_time", "time")).select("impl_id", _r("skewness"), _r("kurtosis"))


@query("SELECT variant_id, impl_id, round(avg_time / max(avg_time) OVER (PARTITION BY variant_id, step_id), 6) AS normalised, step_id FROM step_fact")
def m12_normalise(lab: Lab) -> DataFrame:
    return model.normalised(lab.steps, ["variant_id", "step_id"], "avg_time").select("variant_id", "impl_id", _r("normalised", 6), "step_id")


@query("SELECT 'total_time' AS field, max(abs(total_time - total_time * (100 + impl_id) // 100))::DOUBLE AS max_abs, round(max(abs(total_time - total_time * (100 + impl_id) // 100) / total_time), 6) AS max_rel, count(*) FILTER (abs(total_time - total_time * (100 + impl_id) // 100) / total_time > 0.025) AS errors FROM run_fact")
def m15_output_diff(lab: Lab) -> DataFrame:
    a = lab.runs.select(F.concat_ws(":", "run_id", "impl_id").alias("id"), "impl_id", "total_time")
    b = a.withColumn("total_time", F.expr("total_time * (100 + impl_id) DIV 100"))
    return model.output_diff(a, b, "id", ["total_time"]).select("field", "max_abs", _r("max_rel", 6), "errors")


@query()
def m8_train_tree(lab: Lab) -> DataFrame:
    """Rows-only: the trained tree's nodes."""
    rows = warehouse.best_per_step(lab.steps, lab.impls).join(lab.variants.select("variant_id", "graph_id"), "variant_id")
    tree, *_ = model.train_tree(rows, ["step_id", "graph_id"], "best_impl")
    return lab.spark.createDataFrame([(i, n.prop, n.threshold, n.left, n.right) for i, n in enumerate(tree)], "node long, prop string, threshold double, left long, right long")


# Table changes


@query("SELECT variant_id, CASE WHEN variant_id % 10 = 0 THEN -1 ELSE graph_id END AS graph_id FROM variant_dim UNION ALL SELECT -5, 0")
def d1_upsert(lab: Lab) -> DataFrame:
    old = lab.variants.select("variant_id", "graph_id")
    new = old.where("variant_id % 10 = 0").withColumn("graph_id", F.lit(-1).cast("long")).unionByName(lab.spark.createDataFrame([(-5, 0)], "variant_id long, graph_id long"))
    return tables.upsert(old, new, ["variant_id"])


@query("SELECT variant_id, CASE WHEN graph_id = 3 THEN 'X' ELSE config_name END AS config_name FROM variant_dim WHERE graph_id <> 4")
def d1_update_delete(lab: Lab) -> DataFrame:
    changed = tables.update_where(lab.variants, F.col("graph_id") == 3, {"config_name": F.lit("X")})
    return tables.delete_where(changed, F.col("graph_id") == 4).select("variant_id", "config_name")


@query("SELECT g.graph_id, c.config_name FROM graph_dim g CROSS JOIN (SELECT DISTINCT config_name FROM variant_dim) c WHERE NOT EXISTS (SELECT 1 FROM variant_dim v WHERE v.graph_id = g.graph_id AND v.config_name = c.config_name AND v.variant_id % 20 = 0)")
def d4_new_variants(lab: Lab) -> DataFrame:
    return tables.new_variants(lab.graphs, lab.variants, lab.variants.where("variant_id % 20 = 0"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d5_duplicate_keys(lab: Lab) -> DataFrame:
    return tables.duplicate_keys(lab.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT variant_id, graph_id FROM variant_dim WHERE variant_id NOT IN (SELECT variant_id FROM run_fact)")
def d5_orphans(lab: Lab) -> DataFrame:
    return tables.orphans(lab.variants.select("variant_id", "graph_id"), lab.runs.select("variant_id").distinct(), {"variant_id": "variant_id"})


# Graphs

_LEVELS = f"b(v, l) AS (SELECT CAST({ROOT} AS BIGINT), 0 UNION SELECT e.dst, b.l + 1 FROM b JOIN edges e ON e.src = b.v WHERE b.l < 12), lv AS (SELECT v, min(l) AS l FROM b GROUP BY v)"


@query(f"{_LEVELS} SELECT id, coalesce(l, 2147483647) AS level FROM vertices LEFT JOIN lv ON v = id", recursive=True)
def g1_bfs_push(lab: Lab) -> DataFrame:
    return _graph(lab).bfs(ROOT, "push")


@query(f"{_LEVELS} SELECT id, coalesce(l, 2147483647) AS level FROM vertices LEFT JOIN lv ON v = id", recursive=True)
def g1_bfs_pull(lab: Lab) -> DataFrame:
    return _graph(lab).bfs(ROOT, "pull")


@query(f"{_LEVELS}, c AS (SELECT l AS level, count(*) AS frontier FROM lv GROUP BY l) SELECT level, frontier, CAST(sum(frontier) OVER (ORDER BY level) AS BIGINT) AS visited, round(frontier / (SELECT count(*) FROM vertices), 6) AS frontier_share, round(sum(frontier) OVER (ORDER BY level) / (SELECT count(*) FROM vertices), 6) AS visited_share FROM c", recursive=True)
def g1e_levels(lab: Lab) -> DataFrame:
    return _graph(lab).levels(ROOT).select("level", "frontier", "visited", _r("frontier_share", 6), _r("visited_share", 6))


@query(
    "n AS (SELECT count(*) AS v FROM vertices), d AS (SELECT src, count(*) AS deg FROM edges GROUP BY src), pr(i, id, r) AS (SELECT 0, id, 1.0::DOUBLE / v FROM vertices, n"
    " UNION ALL SELECT i + 1, e.dst, 0.15 / max(n.v) + 0.85 * sum(pr.r / d.deg) FROM pr JOIN edges e ON e.src = pr.id JOIN d ON d.src = e.src CROSS JOIN n WHERE i < 100 GROUP BY i + 1, e.dst) SELECT id, round(r, 9) AS rank FROM pr WHERE i = 100",
    recursive=True,
)
def g2_pagerank(lab: Lab) -> DataFrame:
    return _graph(lab).pagerank().select("id", _r("rank", 9))


_DEGREES = "deg AS (SELECT 'out' AS kind, v.id, count(e.src) AS d FROM vertices v LEFT JOIN edges e ON e.src = v.id GROUP BY v.id UNION ALL SELECT 'in', v.id, count(e.src) FROM vertices v LEFT JOIN edges e ON e.dst = v.id GROUP BY v.id), alld AS (SELECT * FROM deg UNION ALL SELECT 'abs', id, sum(d) FROM deg GROUP BY id)"


@query(f"{_DEGREES} SELECT kind, id, CAST(d AS BIGINT) AS degree FROM alld")
def g3_degrees(lab: Lab) -> DataFrame:
    g = _graph(lab)
    return g.degrees("out").withColumn("kind", F.lit("out")).unionByName(g.degrees("in").withColumn("kind", F.lit("in"))).unionByName(g.degrees("abs").withColumn("kind", F.lit("abs")))


_SUMMARY = (
    "r AS (SELECT kind, d, row_number() OVER (PARTITION BY kind ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM alld),"
    " st AS (SELECT kind, CAST(min(d) AS DOUBLE) AS min, avg(d) FILTER (i IN ((n // 2 - 1) // 2, (n // 2) // 2)) AS lower, avg(d) FILTER (i IN ((n - 1) // 2, n // 2)) AS median, avg(d) AS mean,"
    " avg(d) FILTER (i IN ((n // 2 - 1) // 2 + n // 2 + n % 2, (n // 2) // 2 + n // 2 + n % 2)) AS upper, CAST(max(d) AS DOUBLE) AS max, stddev_samp(d) AS stddev FROM r GROUP BY kind)"
)


@query(f"{_DEGREES}, {_SUMMARY} SELECT kind, min, lower, median, round(mean, 6) AS mean, upper, max, round(stddev, 6) AS stddev FROM st")
def g4_degree_statistics(lab: Lab) -> DataFrame:
    return _graph(lab).degree_statistics().select("kind", "min", "lower", "median", _r("mean", 6), "upper", "max", _r("stddev", 6))


@query("SELECT d AS degree, count(*) AS vertices FROM (SELECT v.id, count(e.src) AS d FROM vertices v LEFT JOIN edges e ON e.src = v.id GROUP BY v.id) GROUP BY d")
def g5_a19_histogram(lab: Lab) -> DataFrame:
    return _graph(lab).histogram("out")


@query(
    f"{_DEGREES}, {_SUMMARY}, u AS (UNPIVOT st ON min, lower, median, mean, upper, max, stddev INTO NAME s VALUE value) SELECT kind || ' ' || s AS property, round(value, 6) AS value FROM u"
    " UNION ALL SELECT 'vertex count', (SELECT count(*) FROM vertices)::DOUBLE UNION ALL SELECT 'edge count', (SELECT count(*) FROM edges)::DOUBLE"
)
def g7_properties(lab: Lab) -> DataFrame:
    return _graph(lab).properties().select("property", _r("value", 6))


@query(
    "s AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)), b(v) AS (SELECT CAST(0 AS BIGINT) UNION SELECT s.dst FROM b JOIN s ON s.src = b.v)"
    " SELECT round((SELECT count(*) FROM b) / (SELECT count(*) FROM vertices), 9) AS connectivity",
    recursive=True,
)
def g12_connectivity(lab: Lab) -> DataFrame:
    share = _graph(lab).connectivity()
    return lab.spark.createDataFrame([(round(share, 9),)], "connectivity double")


@query(f"{_DEGREES}, c AS (SELECT d, sum(count(*)) OVER (ORDER BY d) AS b, (SELECT count(*) FROM vertices) AS n FROM alld WHERE kind = 'abs' GROUP BY d) SELECT round(1 - max(abs(b / n - least(d / (0.5 * n), 1.0))), 9) AS fitness FROM c")
def g14_fitness(lab: Lab) -> DataFrame:
    return lab.spark.createDataFrame([(round(_graph(lab).fitness(), 9),)], "fitness double")


@query("SELECT i AS src, i + 1 AS dst FROM range(1000) t(i)")
def g10_chain(lab: Lab) -> DataFrame:
    return generate.chain(lab.spark, 1000).edges


@query("SELECT src, dst FROM (SELECT 0::BIGINT AS src, i AS dst FROM range(1, 501) t(i) UNION ALL SELECT i, 0::BIGINT FROM range(1, 501) t(i))")
def g10_star(lab: Lab) -> DataFrame:
    return generate.star(lab.spark, 500, undirected=True).edges


@query("c AS (SELECT i, i // 30 AS r, i % 30 AS k FROM range(600) t(i)) SELECT i AS src, i + 1 AS dst FROM c WHERE k < 29 UNION ALL SELECT i, i + 30 FROM c WHERE r < 19")
def g10_mesh(lab: Lab) -> DataFrame:
    return generate.mesh(lab.spark, 20, 30).edges


@query("c AS (SELECT i, i // 12 AS r, i % 12 AS k FROM range(144) t(i)) SELECT CASE WHEN k < 11 THEN i ELSE i - 11 END AS src, CASE WHEN k < 11 THEN i + 1 ELSE i END AS dst FROM c UNION SELECT CASE WHEN r < 11 THEN i ELSE k END, CASE WHEN r < 11 THEN i + 12 ELSE i END FROM c")
def g10_degree4(lab: Lab) -> DataFrame:
    return generate.degree4(lab.spark, 12).edges


_CELLS = "cells AS (SELECT DISTINCT ('0x' || substr(md5('42:1:' || i), 1, 15))::BIGINT % 25000000 AS cell FROM range(120064) t(i)), placed AS (SELECT cell, row_number() OVER (ORDER BY ('0x' || substr(md5('42:2:' || cell), 1, 15))::BIGINT, cell) AS rn FROM cells)"


@query(f"{_CELLS} SELECT cell // 5000 AS src, cell % 5000 AS dst FROM placed WHERE rn <= 40000")
def g11_random_edges(lab: Lab) -> DataFrame:
    return generate.random_edges(lab.spark, 5000, 40000, SEED)


_LATTICE = "SELECT CASE WHEN (i // s) % {n} < {n} - 1 THEN i ELSE i - ({n} - 1) * s END AS src, CASE WHEN (i // s) % {n} < {n} - 1 THEN i + s ELSE i END AS dst FROM range({cells}) t(i), (VALUES {strides}) w(s)"


@query(f"SELECT DISTINCT src, dst FROM ({_LATTICE.format(n=5, cells=125, strides='(1), (5), (25)')})")
def g10_degree6(lab: Lab) -> DataFrame:
    return generate.degree6(lab.spark, 5).edges


@query(f"SELECT DISTINCT src, dst FROM ({_LATTICE.format(n=4, cells=256, strides='(1), (4), (16), (64)')})")
def g10_torus(lab: Lab) -> DataFrame:
    return generate.torus(lab.spark, 4, 4).edges


@query()
def g8_rank_order(lab: Lab) -> DataFrame:
    """Rows-only: float masking is no SQL."""
    g = _graph(lab)
    return g.rank_order(g.pagerank(5))


@query("q AS (SELECT impl_id, total_time AS d, row_number() OVER (PARTITION BY impl_id ORDER BY total_time) - 1 AS i, count(*) OVER (PARTITION BY impl_id) AS n FROM run_fact) SELECT impl_id, CAST(min(d) AS DOUBLE) AS min, avg(d) FILTER (i IN ((n // 2 - 1) // 2, (n // 2) // 2)) AS lower, avg(d) FILTER (i IN ((n - 1) // 2, n // 2)) AS median, avg(d) FILTER (i IN ((n // 2 - 1) // 2 + n // 2 + n % 2, (n // 2) // 2 + n // 2 + n % 2)) AS upper, CAST(max(d) AS DOUBLE) AS max FROM q GROUP BY impl_id")
def a16_summary(lab: Lab) -> DataFrame:
    return summary(lab.runs, "total_time", ["impl_id"]).drop("mean", "stddev")


# Further operators of the inventory


@query("SELECT src, dst, count(*) AS copies FROM edges GROUP BY ALL")
def s10_edge_dump(lab: Lab) -> DataFrame:
    return lab.edges.select("src", "dst").withColumn("copies", F.lit(1).cast("long"))


@query(f"{_LEVELS} SELECT id || chr(9) || coalesce(l, 2147483647) AS line FROM vertices LEFT JOIN lv ON v = id", recursive=True)
def s20_search_lines(lab: Lab) -> DataFrame:
    return _graph(lab).bfs(ROOT).select(F.concat_ws("\t", "id", "level").alias("line"))


@query(f"SELECT variant_id, step_id, {model.tree_sql(TREE)} AS raw FROM (SELECT DISTINCT s.variant_id, s.step_id, v.graph_id FROM step_fact s JOIN variant_dim v USING (variant_id))")
def s21_exported_tree(lab: Lab) -> DataFrame:
    return _steps_with_graph(lab).select("variant_id", "step_id", F.expr(model.tree_sql(TREE)).alias("raw"))


@query("SELECT variant_id, graph_id FROM variant_dim WHERE graph_id IN (1, 4, 9) AND config_name = 'BUILDING'")
def f4_f6_f8_optional_filters(lab: Lab) -> DataFrame:
    asked = {"graph_id": [1, 4, 9], "config_name": ["BUILDING"], "variant_id": []}
    return lab.variants.where(relational.equals_any(asked)).select("variant_id", "graph_id")


@query("SELECT variant_id, step_id, impl_id, avg_time AS time FROM step_fact WHERE impl_id IN (1, 3)")
def f9_f12_property_sets(lab: Lab) -> DataFrame:
    vectors = fn.dense_vector(lab.impls, lab.steps, ["variant_id", "step_id"], "impl_id", "avg_time", float("nan")).withColumnRenamed("vector", "props")
    kept = warehouse.keep_properties(vectors, keep={1, 2, 3}, drop={2}).select("variant_id", "step_id", F.explode("props").alias("x"))
    return kept.where(~F.isnan("x.value")).select("variant_id", "step_id", F.col("x.key").alias("impl_id"), F.col("x.value").alias("time"))


@query("SELECT r.variant_id, r.run_id, r.impl_id, m.most FROM run_fact r JOIN (SELECT variant_id, max(total_time) AS most FROM run_fact GROUP BY variant_id) m USING (variant_id) WHERE r.total_time = m.most")
def j2_j8_grouped_subquery(lab: Lab) -> DataFrame:
    runs = lab.runs
    most = runs.groupBy("variant_id").agg(F.max("total_time").alias("most"))
    return runs.join(most, "variant_id").where("total_time = most").select("variant_id", "run_id", "impl_id", "most")


@query("SELECT c_custkey AS variant_id, c_nationkey + 0 AS graph_id, n_name AS graph FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j10_natural_keys(lab: Lab) -> DataFrame:
    names = lab.table("nation").select(F.col("n_nationkey").alias("graph_id"), F.col("n_name").alias("graph"))
    rows = lab.table("customer").select(F.col("c_custkey").alias("variant_id"), F.col("c_nationkey").alias("graph_id"))
    return rows.join(names, "graph_id").select("variant_id", "graph_id", "graph")


@query("SELECT variant_id, count(*) AS n, count(*) FILTER (validated) AS valid, min(total_time) FILTER (impl_id < 3) AS least_core FROM run_fact GROUP BY variant_id HAVING count(*) >= 20")
def a1_a5_filtered_aggregates(lab: Lab) -> DataFrame:
    found = lab.runs.groupBy("variant_id").agg(F.count("*").alias("n"), F.count_if("validated").alias("valid"), F.min(F.when(F.col("impl_id") < 3, F.col("total_time"))).alias("least_core"))
    return found.where("n >= 20")


@query("SELECT config_name, count(DISTINCT graph_id) AS graphs, string_agg(DISTINCT CAST(graph_id % 5 AS VARCHAR), ',' ORDER BY CAST(graph_id % 5 AS VARCHAR)) AS classes FROM variant_dim GROUP BY config_name")
def a7_a8_distinct_aggregates(lab: Lab) -> DataFrame:
    classes = F.array_join(F.sort_array(F.collect_set((F.col("graph_id") % 5).cast("string"))), ",")
    return lab.variants.groupBy("config_name").agg(F.countDistinct("graph_id").alias("graphs"), classes.alias("classes"))


@query("SELECT v.variant_id, any_value(g.name) AS graph, sum(r.total_time)::BIGINT AS time FROM run_fact r JOIN variant_dim v USING (variant_id) JOIN graph_dim g USING (graph_id) GROUP BY v.variant_id")
def a15_dependent_column(lab: Lab) -> DataFrame:
    joined = lab.runs.join(lab.variants.select("variant_id", "graph_id"), "variant_id").join(lab.graphs.select("graph_id", F.col("name").alias("graph")), "graph_id")
    return joined.groupBy("variant_id").agg(F.any_value("graph").alias("graph"), F.sum("total_time").alias("time"))


@query("SELECT e.dst AS id, min(e.src) AS least, count(*) AS n FROM edges e GROUP BY e.dst")
def a22_scatter(lab: Lab) -> DataFrame:
    return lab.edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("least"), F.count("*").alias("n"))


@query("SELECT variant_id, step_id, max_time, CAST(sum(step_id + 1) OVER w AS BIGINT) AS all_steps, count(*) OVER w AS n FROM (SELECT variant_id, step_id, max(max_time) AS max_time FROM step_fact GROUP BY ALL) WINDOW w AS (PARTITION BY variant_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def w5_w6_w9_full_frames(lab: Lab) -> DataFrame:
    by = Window.partitionBy("variant_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lab.steps.groupBy("variant_id", "step_id").agg(F.max("max_time").alias("max_time"))
    return rows.withColumn("all_steps", F.sum(F.col("step_id") + 1).over(by)).withColumn("n", F.count("*").over(by))


@query("SELECT impl_id, place FROM (SELECT impl_id, row_number() OVER (ORDER BY CASE WHEN impl_id = -1 THEN 0 ELSE 1 END, time, impl_id) AS place FROM (SELECT impl_id, sum(avg_time) AS time FROM step_fact GROUP BY impl_id UNION ALL SELECT -1, 1e18))")
def o8_report_order(lab: Lab) -> DataFrame:
    rows = lab.steps.groupBy("impl_id").agg(F.sum("avg_time").alias("time")).unionByName(lab.spark.createDataFrame([(fn.OPTIMAL, 1e18)], "impl_id long, time double"))
    return numbered(rows, [F.when(F.col("impl_id") == fn.OPTIMAL, 0).otherwise(1), "time", "impl_id"], "place").select("impl_id", "place")


@query("SELECT graph_id, n FROM (SELECT graph_id, count(*) AS n, -ln((('0x' || substr(md5('42:7:' || graph_id), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0) / count(*) AS place FROM variant_dim GROUP BY graph_id) ORDER BY place LIMIT 8")
def o10_weighted_sample(lab: Lab) -> DataFrame:
    weights = lab.variants.groupBy("graph_id").agg(F.count("*").alias("n"))
    return relational.weighted_sample(weights, "n", "graph_id", 8, SEED)


@query("SELECT dst AS src, src AS dst FROM edges UNION SELECT src, dst FROM edges")
def u2_u4_u5_reverse_union(lab: Lab) -> DataFrame:
    return _graph(lab).reversed.edges.unionByName(lab.edges).distinct()


@query("SELECT variant_id, max(step_id) AS last_step, arg_max(m, step_id) AS last_time FROM (SELECT variant_id, step_id, min(min_time) AS m FROM step_fact GROUP BY ALL) GROUP BY variant_id")
def p5_p8_group_fold(lab: Lab) -> DataFrame:
    rows = lab.steps.groupBy("variant_id", "step_id").agg(F.min("min_time").alias("m"))
    return rows.groupBy("variant_id").agg(F.max("step_id").alias("last_step"), F.max_by("m", "step_id").alias("last_time"))


@query("SELECT graph_id, min(variant_id) AS variant_id FROM variant_dim WHERE (graph_id BETWEEN 2 AND 6 OR graph_id = 11) AND variant_id IN (SELECT min(variant_id) FROM variant_dim WHERE config_name = 'BUILDING' GROUP BY graph_id) GROUP BY graph_id")
def q14_default_variants(lab: Lab) -> DataFrame:
    firsts = lab.variants.where("config_name = 'BUILDING'").groupBy("graph_id").agg(F.min("variant_id").alias("variant_id")).withColumn("config_name", F.lit("BUILDING"))
    return warehouse.default_variants(firsts, "2-6,11", "BUILDING")


@query("SELECT g.name, 'dataset' AS property, CAST(g.dataset_id AS DOUBLE) AS value FROM graph_dim g")
def q15_graph_properties(lab: Lab) -> DataFrame:
    values = lab.graphs.select("graph_id", F.lit("dataset").alias("property"), F.col("dataset_id").cast("double").alias("value"))
    return values.join(lab.graphs.select("graph_id", "name"), "graph_id").select("name", "property", "value")


@query(
    f"{_PREDICTED}, firstset AS (SELECT variant_id, step_id, CASE WHEN raw = -2 THEN 1 ELSE raw END AS answer FROM pred), {_BEST}"
    " SELECT p.variant_id, p.step_id, p.answer AS impl, b.best_impl, round(s.avg_time / b.best_time, 6) AS relative FROM firstset p JOIN best b USING (variant_id, step_id) LEFT JOIN step_fact s ON s.variant_id = p.variant_id AND s.step_id = p.step_id AND s.impl_id = p.answer"
)
def m2_m10_prediction_report(lab: Lab) -> DataFrame:
    predicted = model.predict(_steps_with_graph(lab), TREE, 3, model.resolve_sets(SETS, "firstinset"))
    return model.prediction_report(predicted, warehouse.best_per_step(lab.steps, lab.impls), lab.steps).select("variant_id", "step_id", "impl", "best_impl", _r("relative", 6))


@query(
    "tot AS (SELECT variant_id, impl_id, sum(avg_time) AS time FROM step_fact GROUP BY ALL), opt AS (SELECT variant_id, sum(m) AS base FROM (SELECT variant_id, step_id, min(avg_time) FILTER (impl_id < 3) AS m FROM step_fact GROUP BY ALL) GROUP BY variant_id HAVING sum(m) IS NOT NULL)"
    " SELECT variant_id, impl_id, round(time / base, 6) AS relative FROM tot JOIN opt USING (variant_id)"
)
def m13_heatmap(lab: Lab) -> DataFrame:
    return model.relative_to_optimal(warehouse.impl_totals(lab.steps, lab.impls)).where("impl_id >= 0").select("variant_id", "impl_id", _r("relative", 6))


@query("SELECT variant_id, CASE WHEN variant_id % 4 = 0 THEN 'g' || graph_id ELSE config_name END AS config_name, 0 AS retry_count FROM variant_dim")
def d2_d3_backfill_reset(lab: Lab) -> DataFrame:
    source = lab.variants.where("variant_id % 4 = 0").select("variant_id", F.concat(F.lit("g"), F.col("graph_id")).alias("config_name"))
    filled = tables.backfill(lab.variants.select("variant_id", "config_name", F.lit(3).alias("retry_count")), source, ["variant_id"], ["config_name"])
    return warehouse.reset(filled, "retry_count", 0)


@query("SELECT (SELECT count(*) FROM vertices) AS vertices, (SELECT count(*) FROM edges) AS edges, false AS undirected")
def g6_summary(lab: Lab) -> DataFrame:
    return _graph(lab).counts()


_BIT = "('0x' || substr(md5('42:3:' || {}), 1, 15))::BIGINT % 2 = 0"


@query(
    "b AS (SELECT src, dst, count(*) = 2 AS two FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY src, dst)"
    f" SELECT 'vertex' AS kind, src, dst FROM b WHERE two OR {_BIT.format('dst')} UNION ALL SELECT 'edge', src, dst FROM b WHERE two OR {_BIT.format(chr(39) + chr(39) + ' || dst || ' + chr(39) + ':' + chr(39) + ' || src')}"
)
def g13_hash_crossover(lab: Lab) -> DataFrame:
    g = _graph(lab)
    children = [crossover(g, g.reversed, kind, seed=SEED).edges.select(F.lit(kind).alias("kind"), "src", "dst") for kind in ("vertex", "edge")]
    return children[0].unionByName(children[1])


_RANKS = "n AS (SELECT count(*) AS v FROM vertices), d AS (SELECT src, count(*) AS deg FROM edges GROUP BY src), pr(i, id, r) AS (SELECT 0, id, 1.0::DOUBLE / v FROM vertices, n UNION ALL SELECT i + 1, e.dst, 0.15 / max(n.v) + 0.85 * sum(pr.r / d.deg) FROM pr JOIN edges e ON e.src = pr.id JOIN d ON d.src = e.src CROSS JOIN n WHERE i < {i} GROUP BY i + 1, e.dst)"


@query(f"{_RANKS.format(i=5)} SELECT round(sum(abs(a.r - b.r)), 9) AS change FROM pr a JOIN pr b ON a.id = b.id AND a.i = 5 AND b.i = 4", recursive=True)
def g2c_rank_change(lab: Lab) -> DataFrame:
    return _graph(lab).rank_change(5).select(_r("change", 9))


@query("SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) AS rn, count(*) OVER () AS n FROM supplier")
def w2_w4_whole_table(lab: Lab) -> DataFrame:
    """Row numbers and counts over a whole table."""
    return counted(numbered(lab.table("supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey"]))


@query("SELECT variant_id, step_id, impl_id, sum(avg_time) OVER (PARTITION BY variant_id, impl_id ORDER BY step_id ROWS UNBOUNDED PRECEDING) AS sofar FROM step_fact")
def p9_running_totals(lab: Lab) -> DataFrame:
    return lab.steps.select("variant_id", "step_id", "impl_id", fn.running_total("avg_time", ["variant_id", "impl_id"], ["step_id"]).alias("sofar"))


@query("SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn, count(*) OVER () AS n FROM customer) WHERE rn <= greatest(1, floor(0.2 * n))")
def o10_elite(lab: Lab) -> DataFrame:
    return top_share(lab.table("customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 0.2)


@query("SELECT row_number() OVER () - 1 AS position, column_name AS name FROM (DESCRIBE orders)")
def j9_table_columns(lab: Lab) -> DataFrame:
    return relational.table_columns(lab.table("orders"))


# Sums of means differ in their last digits from engine to engine: tens are compared, cut where no exact sum lies.
@query("SELECT strategy, impl_id, CAST(floor((value + 3.013) / 10) AS BIGINT) AS tens FROM (" + " UNION ALL ".join(f"SELECT '{t}-{h}' AS strategy, impl_id, CAST({ {'min': 'min', 'avg': 'avg', 'total': 'sum'}[h] }({t}_time) AS DOUBLE) AS value FROM step_fact GROUP BY impl_id" for t in ("min", "avg", "max") for h in ("min", "avg", "total")) + ")")
def m2_strategy_ranks(lab: Lab) -> DataFrame:
    return model.strategy_ranks(lab.steps).select("strategy", "impl_id", F.floor((F.col("value") + 3.013) / 10).alias("tens"))


@query("SELECT strategy, CAST(arg_min(impl_id, (value, impl_id)) AS BIGINT) AS impl FROM (" + " UNION ALL ".join(f"SELECT '{t}-{h}' AS strategy, impl_id, CAST({ {'min': 'min', 'avg': 'avg', 'total': 'sum'}[h] }({t}_time) AS DOUBLE) AS value FROM step_fact GROUP BY impl_id" for t in ("min", "avg", "max") for h in ("min", "avg", "total")) + ") WHERE impl_id IN (1, 2) GROUP BY strategy")
def m2_ranked_strategies(lab: Lab) -> DataFrame:
    found = model.resolve_ranked(SETS, lab.steps)
    return lab.spark.createDataFrame([(name, answer[2]) for name, answer in found.items()], "strategy string, impl long")


@query("SELECT l_returnflag AS field, CAST(max(l_quantity) AS DOUBLE) AS max_abs, CAST(max(l_discount) AS DOUBLE) AS max_rel, count(*) AS errors FROM lineitem GROUP BY l_returnflag")
def a21_merged_diffs(lab: Lab) -> DataFrame:
    parts = lab.table("lineitem").groupBy(F.col("l_returnflag").alias("field"), "l_linenumber").agg(F.max("l_quantity").cast("double").alias("max_abs"), F.max("l_discount").cast("double").alias("max_rel"), F.count("*").alias("errors"))
    return model.merged_diffs(parts)


@query("SELECT variant_id, graph_id FROM variant_dim UNION ALL SELECT -5, 0")
def d1_insert_new(lab: Lab) -> DataFrame:
    """Rows of known keys change nothing."""
    old = lab.variants.select("variant_id", "graph_id")
    new = old.withColumn("graph_id", F.lit(-1).cast("long")).unionByName(lab.spark.createDataFrame([(-5, 0)], "variant_id long, graph_id long"))
    return tables.insert_new(old, new, ["variant_id"])[0]


@query("SELECT graph_id, count(*) AS defaults FROM variant_dim WHERE config_name IN ('MACHINERY', 'BUILDING') GROUP BY graph_id HAVING count(*) > 1")
def d5_several_defaults(lab: Lab) -> DataFrame:
    return tables.several_defaults(lab.variants.withColumn("is_default", F.col("config_name").isin("MACHINERY", "BUILDING")), "graph_id", "is_default")


@query(f"{_LEVELS} SELECT id, coalesce(l, 2147483647) AS level FROM vertices LEFT JOIN lv ON v = id", recursive=True)
def g16_bfs_switch(lab: Lab) -> DataFrame:
    return _graph(lab).bfs(ROOT, "switch")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
