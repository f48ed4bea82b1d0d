"""Near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components by large-star and small-star."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_written, free_shuffles, row_key, slices, tidy, utf8, written
from graphloom.llm.components import components

#: 36 bands of 4 minima miss a pair of similarity 0.85 with probability 3e-12, of 0.8 with 6e-9.
BANDS, ROWS = 36, 4
MEMORY_WORDS = 400_000
#: A pair is confirmed unless its signature lies this many standard deviations under the threshold.
DEVIATIONS = 7
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of distinct shingles of ``width`` consecutive words, as sorted 64-bit hashes."""

    def __init__(self, width: int):
        self.width, self.memory = width, {}
        self.factors = np.random.default_rng(11).integers(0, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)

    def _words(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: A-Z alone are lowered, and only space and \x09-\x0D separate
        memory = self.memory
        try:
            found = [*map(memory.__getitem__, words)]
        except KeyError:
            if len(memory) > MEMORY_WORDS:
                memory.clear()
            memory.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(memory))
            found = [*map(memory.__getitem__, words)]
        return np.array(found, np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        words = self._words(text)
        if not len(words):
            return words
        k = min(self.width, len(words))
        n = len(words) - k + 1
        total = np.full(n, k, np.uint64)
        for i in range(k):
            total = _finish(total + words[i : n + i] * self.factors[i])
        return np.unique(total)


class Signer:
    """Minima of many universal (multiply) hash functions over a set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 3):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        self.factors = (rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.band_factors = rng.integers(0, 2**63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 512):
            np.minimum(least, (shingles[None, i : i + 512] * self.factors).min(1), out=least)
        return least

    def bands_of(self, minima: np.ndarray) -> np.ndarray:
        mixed = _finish(minima.reshape(self.bands, self.rows)) * self.band_factors
        return _finish(mixed.sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)

    @staticmethod
    def signature(minima: np.ndarray) -> bytes:
        """One byte of each minimum."""
        return (_finish(minima) >> np.uint64(56)).astype(np.uint8).tobytes()


def _sketches(rows: DataFrame, width: int, bands: int, per_band: int) -> DataFrame:
    def work(batches):
        shingler, signer = Shingler(width), Signer(bands, per_band)
        for batch in slices(batches, 3):
            known: dict[bytes, tuple] = {}
            found = []
            for t in utf8(batch.column(3)):
                if t not in known:
                    s = shingler.shingles(t)
                    least = signer.minima(s) if len(s) else None
                    known[t] = (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signer.bands_of(least).tolist(), signer.signature(least)) if len(s) else (0, None, None, None)
                found.append(known[t])
            n, digests, all_bands, signatures = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(all_bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], ["k", "th", "doc_id", "n_shingles", "digest", "bands", "signature"])

    return rows.mapInArrow(tidy(work), "k long, th long, doc_id long, n_shingles long, digest binary, bands array<long>, signature binary")


def _alike(pairs: DataFrame, classes: DataFrame, threshold: float, hashes: int) -> DataFrame:
    """Signature verification: of pairs (a, b) of nodes those rows (a, tha, b, thb) of classes that agree in enough minima."""
    least = hashes * (threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / hashes))
    one = classes.select(F.col("k").alias("a"), F.col("th").alias("tha"), F.col("signature").alias("sa"))
    other = classes.select(F.col("k").alias("b"), F.col("th").alias("thb"), F.col("signature").alias("sb"))

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
                keep = (x == y).sum(1) >= least
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:4]], ["a", "tha", "b", "thb"])

    joined = pairs.join(one, "a").join(other, "b").select("a", "tha", "b", "thb", "sa", "sb")
    return joined.mapInArrow(work, "a long, tha long, b long, thb long")


def _sets(rows: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(k, th, shingles) of the asked rows. Always a shuffle: what is asked for grows with the corpus."""

    def work(batches):
        shingler = Shingler(width)
        for batch in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([shingler.shingles(t).tobytes() for t in utf8(batch.column(2))], pa.binary())], ["k", "th", "shingles"])

    found = rows.select("k", "th", "text").join(asked.hint("merge"), ["k", "th"])
    return written(found.mapInArrow(tidy(work), "k long, th long, shingles binary").dropDuplicates(["k", "th"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose full shingle sets reach the threshold."""

    def work(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                mine, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    one = sets.select(F.col("k").alias("a"), F.col("th").alias("tha"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("k").alias("b"), F.col("th").alias("thb"), F.col("shingles").alias("sb"))
    joined = pairs.join(one, ["a", "tha"]).join(other, ["b", "thb"]).select("a", "b", "sa", "sb")
    return joined.mapInArrow(tidy(work), "a long, b long").distinct()


def _least(n: Column, part: int, whole: int) -> Column:
    """part * n / whole, rounded up."""
    return F.floor((n * part + (whole - 1)) / whole).cast("long")


def prefix_pairs(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, tha, b, thb) of rows (k, th, label) of different labels among which is every one that reaches the threshold.

    Shingles are put in one order: first those of a single label, which no such pair shares, then by the number of rows that hold them. The first
    common shingle of a linked pair stands among the first n - ceil(t n) + 1 of each of its sets of n, and what follows it is long enough for the
    overlap that the threshold asks for; so rows meet only in such shingles, in like sizes. Boilerplate that many rows hold comes last and brings
    nothing together.
    """

    def explode(batches):
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            sizes = [len(x) for x in found]
            k, th, label = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64), sizes) for i in range(3))
            for i in range(0, len(k), 500_000):
                to = slice(i, i + 500_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[to]) for x in (np.concatenate(found), k, th, label, np.repeat(sizes, sizes))], ["s", "k", "th", "label", "n"])

    rows = open_rows.select("k", "th", "label").distinct().join(sets, ["k", "th"]).select("k", "th", "label", "shingles")
    exploded = rows.mapInArrow(tidy(explode), "s long, k long, th long, label long, n long")
    common = exploded.groupBy("s").agg(F.count("*").alias("rows"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("s", "rows")
    common = written(common, "common")
    lists = exploded.join(common, "s").groupBy("k", "th", "label", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "s"))).alias("list"))
    first = F.col("n") - F.size("list")  # shingles of a single label
    prefix = lists.select("k", "th", "label", "n", first.alias("first"), F.posexplode(F.slice("list", F.lit(1), F.greatest(F.lit(0), F.col("n") - _least(F.col("n"), percent, 100) + 1 - first).cast("int"))).alias("i", "at"))
    prefix = written(prefix.select(F.col("at.s").alias("s"), "k", "th", "label", "n", (F.col("first") + F.col("i")).alias("at")), "prefix")
    mixed = written(prefix.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("s"), "mixed")
    prefix = prefix.join(mixed, "s")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    small = prefix.where(F.col("at") <= F.col("n") - _least(F.col("n"), 2 * percent, 100 + percent)).select("s", band.alias("band"), *[F.col(c).alias(f"{c}1") for c in ("k", "th", "label", "n", "at")])
    large = prefix.select("s", F.explode(F.array(band - 2, band - 1, band)).alias("band"), *[F.col(c).alias(f"{c}2") for c in ("k", "th", "label", "n", "at")])
    overlap = _least(F.col("n1") + F.col("n2"), percent, 100 + percent)
    fits = (F.col("label1") != F.col("label2")) & ((F.col("n1") < F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("k1") < F.col("k2")))
    fits = fits & (F.col("n1") * 100 >= F.col("n2") * percent) & (F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= overlap)
    return small.join(large, ["s", "band"]).where(fits).select(F.col("k1").alias("a"), F.col("th1").alias("tha"), F.col("k2").alias("b"), F.col("th2").alias("thb")).distinct()


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (bucket, k, th, label) of ``members`` whose buckets hold several components."""
    labelled = written(members.join(found.withColumnRenamed("node", "k"), "k", "left").select("bucket", "k", "th", F.coalesce("component", "k").alias("label")), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    out = written(labelled.join(written(mixed, "mixed"), "bucket"), "open")
    drop_written(labelled)
    return out


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """For every row: k, th (its row key), doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id).

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of distinct shingles of ``width`` words, A-Z
    lower-cased; a text of fewer words has its whole sequence as one shingle. Null texts and texts without words have no shingles and no links.
    Rows without an id are linked with nothing (component_id null, kept). Rows that share an id are one document and unite its links.
    Other columns play no part.

    Rows with equal sets form a class that one row stands for. Each class is paired with the smallest of its buckets' smallest members; signatures,
    then full sets decide. The rows of buckets that still hold several components meet the last member of the last component there in the same
    way. What then still lies in a bucket with another component goes through a prefix-filtered join over full sets, so that no pair that meets in a bucket
    goes unjudged unless it is connected already. Groups of copies cost a pair or two per member and bucket, never all pairs.
    """
    rows = docs.select(*row_key(doc_id, text), docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    threshold, hashes = percent / 100, bands * rows_per_band
    sketches = written(_sketches(rows, width, bands, rows_per_band), "sketches")
    linked = sketches.where("digest is not null and doc_id is not null")
    classes = linked.groupBy("digest").agg(F.min(F.struct("k", "th", "bands", "signature")).alias("c"))
    classes = written(classes.select("digest", "c.*"), "classes")
    members = classes.select("k", "th", F.explode("bands").alias("bucket"))
    buckets = written(members.groupBy("bucket").agg(F.min("k").alias("hub"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(members.join(buckets.drop("n"), "bucket"), "members")
    free_shuffles(docs.sparkSession)
    sets = _sets(rows, members.select("k", "th").distinct(), width)
    free_shuffles(docs.sparkSession)
    # First each class against the smallest of all its hubs.
    first = members.where("k <> hub").groupBy("k").agg(F.min("hub").alias("b")).withColumnRenamed("k", "a")
    edges = _confirmed(written(_alike(first, classes, threshold, hashes), "pairs"), sets, percent)
    # Ids whose rows fall into several classes tie these together.
    torn = linked.groupBy("k").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("k")
    ties = linked.join(torn, "k").join(classes.select("digest", F.col("k").alias("of")), "digest").select(F.col("k").alias("a"), F.col("of").alias("b"))
    edges = written(edges.unionByName(ties), "links")
    found = components(edges)
    # Then what the buckets still hold apart: against the last member, then by rare shingles.
    apart = _labelled(members, found)
    last = apart.groupBy("bucket").agg(F.max(F.struct("label", "k")).alias("last"))
    second = apart.join(last, "bucket").where(F.col("label") != F.col("last.label")).select(F.col("k").alias("a"), F.col("last.k").alias("b")).distinct()
    more = written(_confirmed(written(_alike(second, classes, threshold, hashes), "pairs"), sets, percent), "links")
    if not more.isEmpty():
        edges = written(edges.unionByName(more), "links")
        found = components(edges)
        apart = _labelled(apart.select("bucket", "k", "th"), found)
    free_shuffles(docs.sparkSession)
    third = written(prefix_pairs(apart, sets, percent).select("a", "b"), "pairs")
    more = written(_confirmed(written(_alike(third, classes, threshold, hashes), "pairs"), sets, percent), "links")
    if not more.isEmpty():
        found = components(edges.unionByName(more))
    placed = classes.select("digest", F.col("k").alias("node")).join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = linked.select("k", "th", "doc_id", "n_shingles", "digest").join(written(placed, "placed"), "digest").select("k", "th", "doc_id", "n_shingles", F.col("component").alias("component_id"))
    rest = sketches.where("digest is null or doc_id is null").select("k", "th", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns (``__k`` and ``__th`` are reserved)."""
    stay = written(near_groups(docs, doc_id, text, **options).where("kept").select(F.col("k").alias("__k"), F.col("th").alias("__th")), "kept")
    k, th = row_key(doc_id, text)
    return docs.withColumns({"__k": k, "__th": th}).join(stay, ["__k", "__th"], "left_semi").select(*[f"`{c}`" for c in docs.columns])
