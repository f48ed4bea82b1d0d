"""What the corpus operators share: row keys, batches and word rules, with the library's written tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.shared import drop_path, drop_written, new_path, shared_dir, written

__all__ = ["drop_path", "drop_written", "extended", "free_shuffles", "kept_in_worker", "lower_ascii", "new_path", "row_key", "shared_dir", "slices", "tidy", "utf8", "written"]

#: Characters that separate words and that normalisation deletes.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def free_shuffles(spark: SparkSession) -> None:
    """Asks the driver to forget shuffles of finished jobs, so that their files go."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that name a row by what it holds: (k, th). Rows that agree in both have the same id and text."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63) + 1)).alias("k"), F.xxhash64(F.col(doc_id).isNull(), F.col(text)).alias("th")]


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()] if pa.types.is_string(column.type) else [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``max_bytes`` in each; one row may be longer."""
    for batch in batches:
        total, start = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


_KEPT: dict[str, tuple] = {}


def kept_in_worker(name: str, key, make: Callable):
    """``make()``, remembered by the Python worker under ``name`` until asked for with another ``key``: tasks that follow need not make it again."""
    if name not in _KEPT or _KEPT[name][0] != key:
        _KEPT[name] = (key, make())
    return _KEPT[name][1]


def tidy(work: Callable) -> Callable:
    """``work`` for ``mapInArrow``, after which the worker gives its free memory back: workers outlive their tasks and share an executor's memory."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, nothing else; texts of ASCII alone take the shorter way."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def extended(schema: T.StructType, **more: T.DataType) -> T.StructType:
    """``schema`` with more fields; the given one stays as it is."""
    return T.StructType([*schema.fields, *[T.StructField(name, kind) for name, kind in more.items()]])
