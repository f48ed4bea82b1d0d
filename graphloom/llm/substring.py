"""Substring dedup by anchored window hashing; no Lempel-Ziv factors are formed.

The corpus is cut into content-defined blocks: the windows of ``window`` words that share the least hash of their k-grams (the anchor) form a run,
and the words under a run are a block. Equal windows have equal anchors, so a copy of a window lies under a block with the same anchor. Blocks that
occur again are repeated whole. Under an anchor whose blocks differ, the windows of those that occur once, and of one copy of each other, are looked
up on their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_written, free_shuffles, row_key, slices, utf8, written

WINDOW, GRAM = 35, 8
MEMORY_WORDS = 400_000
_BASE = 0x9E3779B97F4A7C15


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Parser:
    """Word hashes, runs and blocks of one text at a time."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.memory: dict[bytes, int] = {}
        self.up = self.down = np.ones(1, np.uint64)

    def hashes(self, text: bytes) -> np.ndarray:
        words = text.split()  # bytes split at exactly space and \x09-\x0D
        memory = self.memory
        try:
            found = [*map(memory.__getitem__, words)]
        except KeyError:
            if len(memory) > MEMORY_WORDS:
                memory.clear()
            memory.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(memory))
            found = [*map(memory.__getitem__, words)]
        return np.array(found, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(2 * n, 1 << 14)
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            steps[0] = 1
            self.down = np.multiply.accumulate(steps)

    def spans(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the words [first, last) of each span."""
        self._powers(len(hashes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_finish(hashes ^ np.uint64(_BASE)) * self.up[: len(hashes)], dtype=np.uint64)])
        return _finish((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def anchors(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window its anchor, and the hashes of all k-grams."""
        n = len(hashes) - self.gram + 1
        grams = np.zeros(n, np.uint64)
        for i in range(self.gram):
            grams = grams * np.uint64(0x2545F4914F6CDD1D) + hashes[i : n + i]
        grams = _finish(grams)
        width, least, have = self.window - self.gram + 1, grams, 1
        while have < width:  # minima over twice as many, the last step overlapping
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        return least, grams

    def runs(self, hashes: np.ndarray):
        """(anchor, block, start, windows) of each run. A run that holds its anchor twice is cut into single windows, which may equal each other."""
        if len(hashes) < self.window:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        least, grams = self.anchors(hashes)
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        sizes = np.diff(np.append(starts, len(least)))
        if len(np.unique(grams)) < len(grams):
            width = self.window - self.gram
            single = [np.count_nonzero(grams[s : s + n + width] == least[s]) < 2 for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            starts = np.concatenate([[s] if one else np.arange(s, s + n) for s, n, one in zip(starts, sizes, single, strict=True)])
            sizes = np.diff(np.append(starts, len(least)))
        return least[starts], self.spans(hashes, starts, starts + sizes + self.window - 1), starts, sizes


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k, th, spans) of the rows (k, th, text) that hold a repeated window: spans of words [first, last) that such windows cover."""
    spark = rows.sparkSession
    tail = window - 1

    def parse(batches):
        parser = Parser(window, gram)
        for batch in slices(batches, 2):
            found = [parser.runs(parser.hashes(t)) for t in utf8(batch.column(2))]
            if found:
                sizes = [len(f[0]) for f in found]
                k, th = (np.repeat(np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64), sizes) for i in (0, 1))
                anchor, block, start, n = (np.concatenate([f[i] for f in found]) for i in range(4))
                yield pa.RecordBatch.from_arrays([_long(anchor), _long(block), pa.array(k), pa.array(th), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["anchor", "block", "k", "th", "start", "n"])

    blocks = written(rows.mapInArrow(parse, "anchor long, block long, k long, th long, start int, n int"), "blocks")
    index = blocks.groupBy("anchor").agg(F.count("*").alias("seen"), F.min("block").alias("low"), F.max("block").alias("high")).where("seen > 1")
    index = written(index.select("anchor", (F.col("low") != F.col("high")).alias("differ")), "index")
    again = written(blocks.join(index, "anchor"), "again")
    drop_written(blocks)
    free_shuffles(spark)
    end = F.col("start") + F.col("n") + tail
    whole = again.where("not differ").select("k", "th", F.col("start").alias("first"), end.alias("last"))
    partly = again.where("differ").select("anchor", "block", "k", "th", "start", "n")
    counts = written(partly.groupBy("anchor", "block").agg(F.count("*").alias("copies")), "counts")
    partly = partly.join(counts, ["anchor", "block"])
    whole = whole.unionByName(partly.where("copies > 1").select("k", "th", F.col("start").alias("first"), end.alias("last")))
    # Window by window: blocks that occur once, against one copy of each block that occurs more often.
    one = partly.where("copies > 1").groupBy("anchor", "block").agg(*[F.first(c).alias(c) for c in ("k", "th", "start", "n")]).select("anchor", "k", "th", "start", "n")
    edges = partly.where("copies = 1").select("anchor", "k", "th", "start", "n").unionByName(one)
    edges = written(edges.groupBy("k", "th").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("runs")), "edges")

    def look_up(batches):
        parser = Parser(window, gram)
        for batch in slices(batches, 2, 4 << 20):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for k, th, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                sizes = np.array([r["n"] for r in runs])
                at = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs])
                for values, x in zip(out, (np.repeat(np.array([r["anchor"] for r in runs], np.int64), sizes), parser.spans(parser.hashes(text), at, at + window), np.full(len(at), k), np.full(len(at), th), at), strict=True):
                    values.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([*map(_long, map(np.concatenate, out))], ["anchor", "hash", "k", "th", "first"])

    single = written(rows.join(edges, ["k", "th"]).select("k", "th", "text", "runs").mapInArrow(look_up, "anchor long, hash long, k long, th long, first long"), "windows")
    free_shuffles(spark)
    twice = written(single.groupBy("anchor", "hash").agg(F.count("*").alias("copies")).where("copies > 1").select("anchor", "hash"), "twice")
    parts = single.join(twice, ["anchor", "hash"]).select("k", "th", F.col("first").cast("int").alias("first"), (F.col("first") + window).cast("int").alias("last"))
    return written(whole.unionByName(parts).groupBy("k", "th").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """For every row: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text.

    Words are runs of anything but space and \\x09-\\x0D, unchanged. A word goes if a window of ``window`` words covers it whose words also stand
    anywhere else, in another row or the same; what is left is joined by single spaces. Null and empty texts have no words; texts shorter than a
    window lose none; of repeated rows each is the other's copy. Windows are judged on the input, so the first occurrence goes too. Other
    columns play no part.
    """
    rows = docs.select(*row_key(doc_id, text), docs[f"`{text}`"].alias("text"))
    spans = repeated_spans(rows, window, gram)
    free_shuffles(docs.sparkSession)

    def cut(batches):
        for batch in slices(batches, 1):
            n, gone, digests, kept = [], [], [], []
            for t, cuts in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = t.split()
                if cuts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [c["first"] for c in cuts], 1)
                    np.add.at(edge, [c["last"] for c in cuts], -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    left = words
                joined = b" ".join(left)
                n.append(len(words))
                gone.append(len(words) - len(left))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode("utf-8", "replace") if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    full = docs.select(*row_key(doc_id, text), docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")).join(spans, ["k", "th"], "left")
    out = full.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if texts else out.drop("kept_text")
