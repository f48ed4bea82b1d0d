"""Exact deduplication as a stateful stream: disk-backed keyed state that never expires, and full bytes checked on hits."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import new_path, slices, utf8, written

#: State lives in RocksDB on disk; all stores of an executor share a bounded part of its memory, and a store is closed once its task has committed: each open
#: one holds some 4 MB of disk that it has not filled.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Fingerprint files that one micro-batch takes.
FILES_PER_BATCH = 2000
_SPACE = b" \t\n\v\f\r"


#: Plan steps over a file scan that give each of its rows once at most.
_PLAIN = {"Project", "Filter"}


def is_plain_scan(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` is a row of a file, and no file row stands for two."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in _PLAIN:
        plan = plan.child()
    if not plan.getClass().getSimpleName().startswith("LogicalRelation"):
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file`` and ``__row``, by which a row's content can be read again. Rows that are more than a plain scan of files are written to the shared folder first."""
    if not is_plain_scan(docs):
        docs = written(docs, "located")
    return docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def _fingerprints(rows: DataFrame, digest_bytes: int) -> DataFrame:
    """(__file, __row, doc_id, digest, n_points) of each row; equal texts meet in one digest."""

    def work(batches):
        for batch in slices(batches, 3):
            digests = [hashlib.sha256(t.translate(None, _SPACE)).digest() for t in utf8(batch.column(3))]
            points = pc.fill_null(pc.utf8_length(batch.column(3)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.binary()), pa.array([d[:digest_bytes] for d in digests], pa.binary()), points], ["__file", "__row", "doc_id", "sha256", "digest", "n_points"])

    return rows.mapInArrow(work, "__file string, __row long, doc_id long, sha256 binary, digest binary, n_points long")


def _best(*more: str):
    """Most code points, then the smallest id (null ids last), then a place: the row of a group that stays."""
    order = F.when(F.col("doc_id").isNull(), F.lit(-(2**63))).otherwise(F.bitwise_not("doc_id"))
    return F.max(F.struct("n_points", order.alias("order"), "__file", "__row", "doc_id", *more))


def _keyed_state(marks: DataFrame, path: str) -> DataFrame:
    """Runs the stream of fingerprints through the state; returns what it holds in the end: (digest, best, size).

    The state is keyed by digest and keeps the stable identifier and the content locator of the best row so far, and the count. There is no
    watermark, so that nothing expires. Each task sums up its own rows of a digest before the shuffle.
    """
    spark = marks.sparkSession
    old = {key: spark.conf.get(key, None) for key in STATE}
    out = new_path(spark, "state-out")
    changed = spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path).groupBy("digest").agg(_best().alias("best"), F.count("*").alias("size"))
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        query = (
            changed.writeStream.outputMode("update").option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
        )
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()
    held = spark.read.schema(changed.schema).parquet(f"{out}/batch=*") if query.recentProgress and any(p["numInputRows"] for p in query.recentProgress) else spark.createDataFrame([], changed.schema)
    return written(held.groupBy("digest").agg(F.max(F.struct("size", "best")).alias("last")).select("digest", "last.best", "last.size"), "state")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32) -> DataFrame:
    """For every row its group of equal texts: (__file, __row, doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are identical without the characters space and \\x09-\\x0D; null counts as empty. Of a group the row with the
    most code points in its original text stays, then the smallest id (a null id last); of rows that agree in both exactly one. Other columns
    play no part. Rows whose digest is held already are hits: their full texts are read again by their locators and compared, and if a digest
    stands for several texts, its group is split by the texts themselves. ``digest_bytes`` shortens the digest (for tests).
    """
    rows = located(docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")))
    rows = rows.select("__file", "__row", "doc_id", "text")
    marks = written(_fingerprints(rows, digest_bytes), "marks")
    state = _keyed_state(marks, marks._graphloom_path)
    hits = marks.join(state.where("size > 1").select("digest"), "digest").select("__file", "__row", "digest")
    bare = rows.select("__file", "__row", F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "").alias("bare"))
    # Equal if the least and the greatest are; both are summed up in each task before the shuffle.
    torn = written(hits.join(bare, ["__file", "__row"]).groupBy("digest").agg(F.min("bare").alias("least"), F.max("bare").alias("most")).where("least <> most").select("digest"), "torn")
    if torn.isEmpty():
        joined = marks.join(state, "digest")
    else:
        split = marks.join(torn, "digest").join(bare, ["__file", "__row"])
        apart = split.groupBy("digest", "bare").agg(_best().alias("best"), F.count("*").alias("size"))
        again = split.join(apart, ["digest", "bare"]).select(*marks.columns, "best", "size")
        joined = marks.join(state.join(torn, "digest", "left_anti"), "digest").select(*marks.columns, "best", "size").unionByName(again)
    kept = (F.col("best.__file") == F.col("__file")) & (F.col("best.__row") == F.col("__row"))
    return joined.select("__file", "__row", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns. Columns ``__file`` and ``__row`` are reserved."""
    names = docs.columns
    if not is_plain_scan(docs):
        docs = written(docs, "docs")
    source = located(docs)
    stay = exact_groups(docs, doc_id, text).where("kept").select("__file", "__row")
    return source.join(stay, ["__file", "__row"], "left_semi").select(*[f"`{c}`" for c in names])
