"""Toxicity: bags of subword vectors, averaged over segments, under a linear softmax; all trained jointly in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import extended, slices, tidy, utf8

BUCKETS, DIMENSIONS, SHORTEST, LONGEST = 1 << 17, 8, 3, 6
#: Words of a segment. A text is judged by its worst segment, so that length does not dilute an insult.
SEGMENT = 8
#: The model is learnt from at most this many labelled rows of each class, of at most this many bytes each.
ROWS_PER_CLASS, BYTES_PER_ROW = 3000, 12_000
ROUNDS, STEPS, RATE, DECAY = 5, 20, 0.08, 2e-4
MEMORY_WORDS = 400_000
#: Stripped from both ends of a word.
_EDGE = b".,;:!?\"'()[]{}<>*#$%&-_/\\|~^=+@`"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return [w for x in text.translate(_FOLD).split() if (w := x.strip(_EDGE))]


def buckets_of(word: bytes) -> list[int]:
    """The word itself and its character n-grams, with marks at both ends, as bucket numbers."""
    try:
        chars = word.decode()
    except UnicodeDecodeError:
        chars = word.decode("latin-1")
    marked = f"<{chars}>"
    grams = {marked}
    for n in range(SHORTEST, min(LONGEST, len(marked)) + 1):
        grams.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


@dataclass
class ToxicityModel:
    """``weight[b]``: what bucket b's vector adds to the logit of label 1; ``bias``; ``scale`` and ``shift`` set the worst segment's logit on a probability."""

    weight: np.ndarray
    bias: float
    scale: float
    shift: float

    def __post_init__(self):
        self.memory: dict[bytes, float] = {}

    def word_logits(self, words: list[bytes]) -> list[float]:
        memory = self.memory
        if new := set(words).difference(memory):
            if len(memory) + len(new) > MEMORY_WORDS:
                memory.clear()
                new = set(words)
            for w in new:
                found = buckets_of(w)
                memory[w] = float(self.weight[found].sum()) / len(found)
        return [*map(memory.__getitem__, words)]

    def score(self, text: bytes) -> float:
        logits = np.array(self.word_logits(words_of(text)) or [0.0])
        return float(1 / (1 + np.exp(-np.clip(self.scale * (worst_segment(logits)[0] + self.bias) + self.shift, -30, 30))))


def worst_segment(logits: np.ndarray) -> tuple[float, int]:
    """The highest mean over segments of ``SEGMENT`` words that overlap by half, and where it begins; a shorter text is one segment."""
    if len(logits) <= SEGMENT:
        return float(logits.mean()), 0
    sums = np.concatenate([[0.0], np.cumsum(logits)])
    starts = np.unique(np.append(np.arange(0, len(logits) - SEGMENT, SEGMENT // 2), len(logits) - SEGMENT))
    means = (sums[starts + SEGMENT] - sums[starts]) / SEGMENT
    best = int(means.argmax())
    return float(means[best]), int(starts[best])


class _Trainer:
    def __init__(self, texts: list[bytes], labels: np.ndarray, seed: int):
        self.labels = labels.astype(np.float64)
        self.index: dict[bytes, int] = {}
        self.docs, grams = [], []
        for t in texts:  # a text's words are given up for numbers before the next one is split
            words = words_of(t)
            for w in words:
                if w not in self.index:
                    self.index[w] = len(self.index)
                    grams.append(np.array(buckets_of(w), np.int32))
            self.docs.append(np.array([self.index[w] for w in words] or [-1], np.int32))
        self.gram = np.concatenate(grams) if grams else np.zeros(1, np.int32)
        self.sizes = np.array([len(g) for g in grams] or [1])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.softmax = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.vectors, self.softmax, self.bias)]
        self.t = 0
        self.rng = rng

    def word_vectors(self) -> np.ndarray:
        return np.add.reduceat(self.vectors[self.gram], self.starts, axis=0) / self.sizes[:, None].astype(np.float32)

    def step(self, segments: list[np.ndarray], y: np.ndarray) -> float:
        """One step of Adam on the mean cross entropy; classes weigh the same."""
        sizes = np.array([len(s) for s in segments])
        flat, starts = np.concatenate(segments), np.concatenate([[0], np.cumsum(sizes)])[:-1]
        used, flat = np.unique(flat, return_inverse=True)
        take = np.concatenate([np.arange(a, a + n) for a, n in zip(self.starts[used], self.sizes[used], strict=True)])
        gram, gsize = self.gram[take], self.sizes[used]
        gstart = np.concatenate([[0], np.cumsum(gsize)])[:-1]
        words = np.add.reduceat(self.vectors[gram], gstart, axis=0) / gsize[:, None].astype(np.float32)
        mean = np.add.reduceat(words[flat], starts, axis=0) / sizes[:, None].astype(np.float32)
        logits = mean @ self.softmax + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
        loss = float(-(weight * np.log(p[np.arange(len(y)), y] + 1e-9)).sum())
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        d_mean = (p @ self.softmax.T) / sizes[:, None].astype(np.float32)
        d_token = np.repeat(d_mean, sizes, axis=0)
        d_vectors = np.empty_like(self.vectors)
        for k in range(DIMENSIONS):
            d_word = np.bincount(flat, d_token[:, k], len(used)) / gsize
            d_vectors[:, k] = np.bincount(gram, np.repeat(d_word, gsize), BUCKETS)
        self.t += 1
        grads = (d_vectors + DECAY / BUCKETS * self.vectors, mean.T @ p, p.sum(0))
        for param, grad, (m, v) in zip((self.vectors, self.softmax, self.bias), grads, self.moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
        return loss

    def pieces(self, doc: np.ndarray) -> list[np.ndarray]:
        return [doc[i : i + SEGMENT] for i in range(0, len(doc), SEGMENT)]

    def train(self) -> ToxicityModel:
        docs = [d[d >= 0] for d in self.docs]
        clean = [s for d, y in zip(docs, self.labels, strict=True) if not y for s in self.pieces(d) if len(s)]
        for r in range(ROUNDS):
            hard: list[np.ndarray] = []
            if r == 0:  # every segment of a toxic text counts as toxic
                toxic = [s for d, y in zip(docs, self.labels, strict=True) if y for s in self.pieces(d) if len(s)]
            else:  # then the one that the model finds worst, against the worst ones of the clean texts
                logit = self.word_logits()
                toxic = []
                for d, y in zip(docs, self.labels, strict=True):
                    if len(d):
                        at = worst_segment(logit[d])[1]
                        (toxic if y else hard).append(d[at : at + SEGMENT])
            if not toxic or not clean:
                break
            for _ in range(STEPS):
                pick = [clean[i] for i in self.rng.choice(len(clean), min(len(clean), 6000), replace=False)] + hard
                some = toxic if len(toxic) <= 9000 else [toxic[i] for i in self.rng.choice(len(toxic), 9000, replace=False)]
                self.step([*some, *pick], np.array([1] * len(some) + [0] * len(pick)))
        weight = self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])
        bias = float(self.bias[1] - self.bias[0])
        logit = self.word_logits()
        worst = np.array([worst_segment(logit[d])[0] + bias if len(d) else bias for d in docs])
        scale, shift = _calibrate(worst, self.labels)
        return ToxicityModel(weight.astype(np.float64), bias, scale, shift)

    def word_logits(self) -> np.ndarray:
        return (self.word_vectors() @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the worst segment's logit, by Newton steps with a little shrinkage."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    at, spread = x.mean(), x.std() + 1e-9
    z = np.stack([(x - at) / spread, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1.0, 1e-3])
        w -= np.clip(np.linalg.solve(hessian, z.T @ (p - y) + np.array([1.0, 1e-3]) * w), -2, 2)
    w[0] = max(w[0], 1e-3)
    return float(w[0] / spread), float(w[1] - w[0] * at / spread)


def learn_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows_per_class: int = ROWS_PER_CLASS, bytes_per_row: int = BYTES_PER_ROW, seed: int = 7) -> ToxicityModel:
    """A model from the texts of ``docs`` whose ids have a label 0 or 1 in ``labels``.

    Learns from the texts of at most ``rows_per_class`` ids of each class, those with the least hashes, as far as they are of up to
    ``bytes_per_row`` bytes; both bounds are the model's parameters. Ids are drawn from ``labels`` alone, so that only their texts are read from
    ``docs`` and nothing else of it moves; what reaches the driver is at most two classes of these rows. Of several texts of an id the least one counts, of several labels the greatest.
    Rows without an id, a text or a label 0 or 1 teach nothing. Without texts of both classes every score is 0.5 before calibration.
    """
    spark = docs.sparkSession
    marks = labels.select(labels[f"`{doc_id}`"].cast("long").alias("id"), labels[f"`{label}`"].cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = {r["id"]: r["label"] for y in (0, 1) for r in marks.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(rows_per_class).collect()}
    if len({*chosen.values()}) < 2:
        return ToxicityModel(np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "id long"))  # two times rows_per_class at most
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("text")).join(ids, "id").where(F.octet_length("text") <= bytes_per_row)
    found = sorted((r["text"], chosen[r["id"]]) for r in rows.groupBy("id").agg(F.min("text").alias("text")).collect())
    if len({y for _, y in found}) < 2:
        return ToxicityModel(np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    return _Trainer([t.encode() for t, _ in found], np.array([y for _, y in found]), seed).train()


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds ``score`` (0 to 1, from the whole text alone) and ``predicted`` (1 if score >= 0.5).

    A text's score is the model's for its worst segment of ``SEGMENT`` words, set on a probability by the model's ``scale`` and ``shift``.

    Null and empty texts get the score of a text without any evidence. Other columns stay; columns already so named are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.scale, model.shift))
    kept = [c for c in docs.columns if c not in (score, predicted)]
    at = kept.index(text)

    def work(batches):
        judge = ToxicityModel(*shared.value)
        for batch in slices(batches, at, 4 << 20):
            found = [judge.score(t) for t in utf8(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array([int(x >= 0.5) for x in found], pa.int32())], [*batch.schema.names, score, predicted])

    slim = docs.select(*[docs[f"`{c}`"] for c in kept])
    return slim.mapInArrow(tidy(work), extended(slim.schema, **{score: T.DoubleType(), predicted: T.IntegerType()}))
