"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a bucket should hold.
BUCKET_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a local folder where that is unset and the master is local (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("graphloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("graphloom.shared.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where, system = _file_system(spark, path)
    system.delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path  # so that the maker can drop it early
    return out


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for so many rows: ``BUCKET_ROWS`` each, as many as there are cores at least and as Spark allows at most."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS)))


def bucketed(df: DataFrame, keys: list[str], buckets: int, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, in buckets of ``keys``: a join on them shuffles its other side alone."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = f"graphloom_{path.rsplit('-', 1)[1]}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._graphloom_path, out._graphloom_table = path, name
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes a table of ``written`` or ``bucketed`` that nothing reads any more."""
    if name := getattr(df, "_graphloom_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    drop_path(df.sparkSession, df._graphloom_path)
