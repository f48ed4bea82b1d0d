"""The binary graph format, versions 0 and 1.

Version 0 is 32-bit words: undirected, V, E. Version 1 starts with ten 32-bit words: version 1, 0, 0, undirected, width of a vertex, width of an edge,
then V and E as 64-bit numbers. Then V + 1 offsets and E targets; a directed graph has both again for its reversed edges. An element is 8 bytes wide if
its bound exceeds 32 bits.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph

_EDGES = "path string, src long, dst long"
_NARROW = 2**32 - 1


def parse(raw: bytes) -> tuple[bool, int, np.ndarray, np.ndarray]:
    """(undirected, V, offsets, targets) of a file's forward edges; a file of another size than its header says is refused."""
    words = np.frombuffer(raw[:40], "<u4")
    if len(words) >= 10 and words[1] == 0 and words[2] == 0 and words[0] == 1:
        undirected, (v, e), at = bool(words[3]), struct.unpack("<QQ", raw[24:40]), 40
        edge_type, vertex_type = f"<u{words[5]}", f"<u{words[4]}"
    else:
        if len(words) < 3:
            raise ValueError("no graph file")
        undirected, v, e, at = bool(words[0]), int(words[1]), int(words[2]), 12
        edge_type = vertex_type = "<i4"
    one = (v + 1) * np.dtype(edge_type).itemsize + e * np.dtype(vertex_type).itemsize
    if len(raw) != at + one * (1 if undirected else 2):
        raise ValueError(f"graph file of {len(raw)} bytes; its header says {at + one * (1 if undirected else 2)}")
    offsets = np.frombuffer(raw, edge_type, v + 1, at)
    targets = np.frombuffer(raw, vertex_type, e, at + offsets.nbytes)
    if len(targets) and (int(targets.max()) >= v or int(targets.min()) < 0):
        raise ValueError("a target is no vertex")
    return undirected, v, offsets.astype(np.int64), targets.astype(np.int64)


def read_native(spark: SparkSession, path: str) -> Graph:
    """The graph of one file; the file is read by one task, its edges come out in batches."""

    def work(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, v, offsets, targets = parse(raw)
                src = np.repeat(np.arange(v), np.diff(offsets))
                for i in range(0, max(1, len(src)), 1 << 20):
                    part = slice(i, i + (1 << 20))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(src[part])), pa.array(src[part]), pa.array(targets[part])], ["path", "src", "dst"])

    files = spark.read.format("binaryFile").load(path)
    edges = files.select("path", "content").mapInArrow(work, _EDGES).select("src", "dst")
    head = files.select(F.expr("substring(content, 1, 40)").alias("head")).first()["head"]
    words = np.frombuffer(bytes(head[: len(head) // 4 * 4]), "<u4")
    newer = len(words) >= 10 and words[0] == 1 and words[1] == 0 and words[2] == 0
    undirected, v = (bool(words[3]), struct.unpack("<Q", bytes(head[24:32]))[0]) if newer else (bool(words[0]), int(words[1]))
    return Graph(edges, spark.range(v), undirected)


def _arrays(edges: DataFrame, v: int) -> list[np.ndarray]:
    e = edges.count()
    rows = edges.orderBy("src", "dst").toLocalIterator(prefetchPartitions=True)
    targets, counts = np.empty(e, np.int64), np.zeros(v + 1, np.int64)
    for i, r in enumerate(rows):
        targets[i] = r["dst"]
        counts[r["src"] + 1] += 1
    width = lambda bound: "<u8" if bound > _NARROW else "<u4"
    return [np.cumsum(counts).astype(width(e)), targets.astype(width(v))]


def write_native(graph: Graph, path: str, distinct: bool = True) -> None:
    """Writes version 1 to one local file, in the driver: the format is a single file for one machine. Edges are sorted by Spark and streamed by partition."""
    edges = graph.edges.distinct() if distinct else graph.edges
    v, parts = graph.vertices.count(), _arrays(edges, graph.vertices.count())
    if not graph.undirected:
        parts += _arrays(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), v)
    with open(path, "wb") as out:
        out.write(struct.pack("<6I2Q", 1, 0, 0, graph.undirected, parts[1].itemsize, parts[0].itemsize, v, len(parts[1])))
        for p in parts:
            out.write(p.tobytes())
