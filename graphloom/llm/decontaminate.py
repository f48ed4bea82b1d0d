"""Benchmark decontamination by winnowing, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import lower_ascii, row_key, written

#: Words of a window and of the k-grams whose least hash stands for it.
WINDOW, GRAM = 10, 5
#: Rows and bytes of the benchmark's fingerprints or windows that are broadcast at most; beyond that the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: What separates words once A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")


def _sequence(n: Column) -> Column:
    """1 to n; empty if n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _gram_hashes(words: Column, k: int) -> Column:
    return F.transform(_sequence(F.size(words) - (k - 1)), lambda i: F.xxhash64(F.lit(k), F.slice(words, i, k)))


def window_marks(words: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """For each window of words the least hash of its k-grams; two equal windows have equal marks, whatever stands around them."""
    width = window - gram + 1
    return _let(_gram_hashes(words, gram), lambda h: F.transform(_sequence(F.size(h) - (width - 1)), lambda i: F.array_min(F.slice(h, i, width))))


def _sized(df: DataFrame) -> DataFrame:
    """``df`` (a written table of one column) marked for broadcast if it has few enough rows and bytes."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(df.columns[0]).cast("string"))), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document row: k, th (its row key), doc_id, n_words, n_hit, items (distinct item ids with an occurring window).

    Words are runs of letters and digits of ASCII and of all characters beyond, A-Z lower-cased. A window is ``window`` consecutive words of an
    item; an item with fewer words, but not none, is one window. A document's word is hit inside any occurrence of a window. Winnowing finds
    every occurrence: a window and its copy have the same least k-gram hash. Candidates are then extended to whole windows and compared as
    words. Null and empty texts have no words; items without an id hit words but are not listed; repeated rows get a row each. Other columns
    of both tables play no part.
    """
    items = benchmark.select(benchmark[f"`{item_id}`"].alias("item_id"), words_of(benchmark[f"`{item_text}`"]).alias("words")).where(F.size("words") > 0)
    items = written(items, "items")
    short = sorted(r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().collect())  # at most window - 1 lengths
    lengths = F.least(F.size("words"), F.lit(window))
    grams = items.select("item_id", F.explode(F.transform(_sequence(F.size("words") - lengths + 1), lambda i: F.array_join(F.slice("words", i, lengths), " "))).alias("window"))
    grams = written(grams.distinct(), "windows")
    windows = _sized(written(grams.select("window").distinct(), "windows"))
    marks = items.select(F.explode(F.when(F.size("words") >= window, window_marks(F.col("words"), window, gram)).otherwise(F.array(F.xxhash64(F.size("words"), "words")))).alias("mark")).distinct()
    marks = _sized(written(marks, "marks"))

    def all_marks(w: Column) -> Column:
        return F.concat(window_marks(w, window, gram), *[_gram_hashes(w, n) for n in short])

    rows = docs.select(*row_key(doc_id, text), docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    found = rows.select("k", "th", "doc_id", _let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.array_distinct(all_marks(w)).alias("marks"))).alias("of"))
    found = written(found.select("k", "th", "doc_id", F.col("of.n").cast("long").alias("n_words"), "of.marks"), "fingerprints")
    hits = found.select("k", "th", F.explode("marks").alias("mark")).join(marks, "mark").groupBy("k", "th").agg(F.collect_set("mark").alias("hits"))
    candidates = rows.select("k", "th", "text").join(hits, ["k", "th"])

    def starts(w: Column, marked: Column, n: int) -> Column:
        """(start, length, words) of each window of n words whose mark is a hit."""
        some = F.filter(F.transform(marked, lambda m, i: F.when(F.array_contains("hits", m), i + 1)), lambda i: i.isNotNull())
        return F.transform(some, lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(w, i, n), " ").alias("window")))

    extended = candidates.select("k", "th", F.explode(_let(words_of(F.col("text")), lambda w: F.concat(starts(w, window_marks(w, window, gram), window), *[starts(w, _gram_hashes(w, n), n) for n in short]))).alias("at"))
    extended = written(extended.select("k", "th", "at.*").join(windows, "window"), "occurrences")
    listed = extended.select("k", "th", "window").distinct().join(grams.where("item_id is not null"), "window").groupBy("k", "th").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    # Covered words: spans in the order of their starts, each counted beyond the end of those before.
    spans = extended.groupBy("k", "th").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], a["end"]))).alias("n"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"])
    hit = spans.select("k", "th", covered.cast("long").alias("n_hit")).join(listed, ["k", "th"], "left")
    kind = dict(hit.dtypes)["items"]
    return found.select("k", "th", "doc_id", "n_words").join(hit, ["k", "th"], "left").select("k", "th", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast(kind)).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns (``__k`` and ``__th`` are reserved)."""
    bad = written(benchmark_hits(docs, benchmark, doc_id, text, **options).where("n_hit > 0").select(F.col("k").alias("__k"), F.col("th").alias("__th")).distinct(), "contaminated")
    k, th = row_key(doc_id, text)
    return docs.withColumns({"__k": k, "__th": th}).join(bad, ["__k", "__th"], "left_anti").select(*[f"`{c}`" for c in docs.columns])
