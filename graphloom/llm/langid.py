"""Language identification with bit-sliced Bloom filters: one lookup of an n-gram gives the set of languages that contain it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import drop_written, extended, slices, tidy, utf8, written

#: Bytes of an n-gram; it fits in 32 bits.
GRAM = 4
#: Positions of the filters (a power of two) and hash functions.
POSITION_BITS, HASHES = 21, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: The model is learnt from about this many labelled rows of a language, and keeps this many n-grams of each.
ROWS_PER_LANGUAGE, GRAMS_PER_LANGUAGE = 3000, 60_000
#: An n-gram belongs to a language if it is at least this part as frequent there as in the language where it is most frequent.
LEAST_SHARE = 0.05
#: Of more languages than this the ones with most rows are learnt (of equal ones the first by name); each 64 take another mask word at every position.
MAX_LANGUAGES = 256
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 20
#: A text is in a known language if at least this part of its n-grams belongs to the predicted one. Of up to 4,000 rows each
#: of sf0.001, sf0.01 and sf0.1 all reach 0.59; single sentences in Dutch, Swedish, other scripts, mojibake and random letters reached 0.26 at most.
LEAST_KNOWN = 0.4
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = regex.compile("[A-Za-z]")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLANK = 0x20202020


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, one after the other, and where those of each text begin. Texts stand between blanks."""
    pad = b" " * GRAM
    joined = np.frombuffer((pad + pad.join(texts) + pad).translate(_FOLD), np.uint8).astype(np.uint32)
    n = len(joined) - GRAM + 1
    grams = joined[:n].copy()
    for k in range(1, GRAM):
        grams |= joined[k : n + k] << np.uint32(8 * k)
    return grams, np.concatenate([[0], np.cumsum([len(t) + GRAM for t in texts])])[:-1]


def _places(grams: np.ndarray):
    for c in HASHES:
        yield (grams * np.uint32(c)) >> np.uint32(32 - POSITION_BITS)


@dataclass
class LanguageFilters:
    """Bit l % width of ``tables[l // width][p]`` is set if position p is set in the filter of ``languages[l]``; ``wrong[l]`` is that filter's false-positive rate."""

    languages: list[str]
    tables: list[np.ndarray]
    wrong: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageFilters:
        languages = sorted(grams)
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if np.dtype(k).itemsize * 8 >= len(languages)), np.uint64)
        width = np.dtype(kind).itemsize * 8
        tables, wrong = [np.zeros(1 << POSITION_BITS, kind) for _ in range(max(1, -(-len(languages) // width)))], np.zeros(len(languages))
        for i, name in enumerate(languages):
            table, bit = tables[i // width], kind(1 << i % width)
            for places in _places(grams[name].astype(np.uint32)):
                table[places] |= bit
            wrong[i] = float(((table & bit) != 0).mean()) ** len(HASHES)
        return cls(languages, tables, wrong)

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the set of languages whose filters hold it, as one array of mask words per table."""
        found: list[np.ndarray] = []
        for places in _places(grams):
            now = [table[places] for table in self.tables]
            found = [f & x for f, x in zip(found, now, strict=True)] if found else now
        return found

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the number of its n-grams found there, less those that the filter's errors explain; and each text's number of n-grams."""
        grams, starts = _grams(texts)
        found, seen = self.masks(grams), grams != _BLANK
        n = np.add.reduceat(seen, starts, dtype=np.int64)
        width, one = found[0].dtype.itemsize * 8, found[0].dtype.type(1)
        for masks in found:
            masks[~seen] = 0
        hits = np.stack([np.add.reduceat((found[i // width] >> found[0].dtype.type(i % width)) & one, starts, dtype=np.int64) for i in range(len(self.languages))], 1)
        return np.maximum(0, (hits - self.wrong * n[:, None]) / (1 - self.wrong)), n


def learn_filters(labelled: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, grams_per_language: int = GRAMS_PER_LANGUAGE) -> LanguageFilters:
    """Filters from rows that have a text and a language.

    Learns from a sample of about ``rows_per_language`` whole texts of each language, chosen by a hash of the text, and keeps the
    ``grams_per_language`` most frequent n-grams of each; both bounds are the model's parameters, and so is ``MAX_LANGUAGES``. No rows: no languages.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return LanguageFilters.build({})
    scale = 1 << 30
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, int(scale * min(1.0, rows_per_language / n))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(scale)) < share)

    def count(batches):
        for batch in slices(batches, 0, SLICE_BYTES):
            langs, texts = np.array(batch.column(1).to_pylist(), object), utf8(batch.column(0))
            for name in set(langs):
                grams, n = np.unique(_grams([t for t, x in zip(texts, langs, strict=True) if x == name])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.mapInArrow(tidy(count), "lang string, gram long, n long").where(F.col("gram") != _BLANK).groupBy("gram").pivot("lang", sorted(sizes)).agg(F.sum("n"))
    columns = [F.coalesce(F.col(f"`{name}`"), F.lit(0)).alias(f"l{i}") for i, name in enumerate(sorted(sizes))]
    table = written(counts.select("gram", *columns), "grams")
    grams = {}
    totals = table.agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(len(sizes))]).first()
    rate = [F.col(f"l{i}") / F.lit(float(totals[f"l{i}"] or 1)) for i in range(len(sizes))]
    top = F.greatest(*rate) if len(rate) > 1 else rate[0]
    for i, name in enumerate(sorted(sizes)):
        kept = table.where((F.col(f"l{i}") > 0) & (rate[i] >= F.lit(LEAST_SHARE) * top)).orderBy(F.desc(f"l{i}"), "gram").limit(grams_per_language)
        grams[name] = np.array([r["gram"] for r in kept.select("gram").collect()], np.int64)
    drop_written(table)
    return LanguageFilters.build(grams)


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text", prediction: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """Adds ``prediction`` and ``score`` to every row, from its whole text alone.

    The language with most corrected hits wins, of equal ones the first by name; the score is its part of all languages' hits.
    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no language was learnt; a text with letters
    but no known n-gram gets the first language with score 0. ``known``, if named, is the part of the text's n-grams that are corrected hits of the
    winner (0 for ``und``). Other columns stay; columns already so named are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    more = [prediction, score, *([known] if known else [])]
    kept = [c for c in docs.columns if c not in more]
    at = kept.index(text)

    def work(batches):
        model = shared.value
        for batch in slices(batches, at, SLICE_BYTES):
            column = batch.column(at)
            texts = utf8(column)
            names, best, part = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            if model.languages and texts:
                scores, n = model.scores(texts)
                total = scores.sum(1)
                for i, k in enumerate(scores.argmax(1).tolist()):
                    if _ASCII_LETTER.search(t := column[i].as_py() or "") or _LETTER.search(t):
                        names[i], best[i], part[i] = model.languages[k], float(scores[i, k] / total[i]) if total[i] else 0.0, float(scores[i, k] / n[i])
            made = [pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(part, pa.float64())][: len(more)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *more])

    slim = docs.select(*[docs[f"`{c}`"] for c in kept])
    return slim.mapInArrow(tidy(work), extended(slim.schema, **dict(zip(more, (T.StringType(), T.DoubleType(), T.DoubleType())))))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
