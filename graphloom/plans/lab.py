"""The lab's tables as views of the driver's tables: dimensions, runs, step timings and a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Lab:
    """Lazily read tables of one folder. Money becomes whole cents, so that sums and averages are exact."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def datasets(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("dataset_id"), F.col("r_name").alias("name"))

    @property
    def graphs(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("graph_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("dataset_id"))

    @property
    def variants(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("variant_id"), F.col("c_nationkey").cast("long").alias("graph_id"), F.col("c_mktsegment").alias("config_name"))

    @property
    def impls(self) -> DataFrame:
        return self.spark.createDataFrame([(1, "push", "Core"), (2, "pull", "Core"), (3, "switch", "Derived")], "impl_id long, name string, type string")

    @property
    def _timed(self) -> DataFrame:
        cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3 + 1).alias("impl_id"), cents)
        return self.table("orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))

    @property
    def runs(self) -> DataFrame:
        keys = [F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("variant_id"), "impl_id", (F.col("o_orderstatus") != "P").alias("validated"), F.col("o_orderdate").alias("ts")]
        return self._timed.groupBy(*keys).agg(F.sum("cents").alias("total_time"))

    @property
    def steps(self) -> DataFrame:
        keys = [F.col("o_custkey").alias("variant_id"), (F.col("l_linenumber").cast("long") - 1).alias("step_id"), "impl_id"]
        valid = self._timed.where(F.col("o_orderstatus") != "P")
        return valid.groupBy(*keys).agg(F.min("cents").alias("min_time"), F.avg("cents").alias("avg_time"), F.max("cents").alias("max_time"))

    @property
    def edges(self) -> DataFrame:
        by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        return self.table("lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(by).alias("dst")).where("dst is not null").distinct()

    @property
    def vertices(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"))


#: The same views in SQL that any engine reads.
VIEWS = {
    "dataset_dim": "SELECT CAST(r_regionkey AS BIGINT) AS dataset_id, r_name AS name FROM region",
    "graph_dim": "SELECT CAST(n_nationkey AS BIGINT) AS graph_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS dataset_id FROM nation",
    "variant_dim": "SELECT c_custkey AS variant_id, CAST(c_nationkey AS BIGINT) AS graph_id, c_mktsegment AS config_name FROM customer",
    "impl_dim": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'push', 'Core'), (CAST(2 AS BIGINT), 'pull', 'Core'), (CAST(3 AS BIGINT), 'switch', 'Derived')) AS t(impl_id, name, type)",
    "run_fact": "SELECT o.o_orderkey AS run_id, o.o_custkey AS variant_id, l.l_suppkey % 3 + 1 AS impl_id, o.o_orderstatus <> 'P' AS validated, o.o_orderdate AS ts, CAST(SUM(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total_time FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_custkey, l.l_suppkey % 3 + 1, o.o_orderstatus, o.o_orderdate",
    "step_fact": "SELECT o.o_custkey AS variant_id, CAST(l.l_linenumber AS BIGINT) - 1 AS step_id, l.l_suppkey % 3 + 1 AS impl_id, MIN(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS min_time, AVG(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS avg_time, MAX(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS max_time FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus <> 'P' GROUP BY o.o_custkey, l.l_linenumber, l.l_suppkey % 3 + 1",
    "edges": "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) e WHERE dst IS NOT NULL",
    "vertices": "SELECT p_partkey AS id FROM part",
}


def sql(body: str, recursive: bool = False) -> str:
    """``body`` behind those views that it names; ``body`` may begin with further ones, ``name AS (...), ... SELECT``."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    more = not re.match(r"\s*(SELECT|\()", body)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if head and more else ' ' if head else ''}{body}" if head or more else body
