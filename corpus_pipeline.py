"""From raw documents to tokens in five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import round_trip
from graphloom.llm.common import written
from graphloom.llm.decontaminate import drop_contaminated
from graphloom.llm.exactdedup import drop_exact_copies
from graphloom.llm.langid import LEAST_KNOWN, UNDETERMINED, crc_mod, identify, learn_filters
from graphloom.llm.minhash import drop_near_copies
from graphloom.llm.queries import vocabulary_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents whose predicted language explains less than LEAST_KNOWN of their n-grams go, and those without a letter. Learnt from the labelled rows whose crc32(doc_id) mod 4 is not 2; where there are none, all documents stay."""
    filters = learn_filters(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    if not filters.languages:
        return docs
    found = identify(docs, filters, prediction="lang_pred", score="lang_score", known="lang_known")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_known") >= LEAST_KNOWN)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the one with most code points stays, then that with the smallest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on shingles of five words, the document with the smallest id stays."""
    return drop_near_copies(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and whether they decode to the text."""
    coded = round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary_path())
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"), "token_ids")


STAGES = [
    ("language identification", known_language),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("tokens", tokenize),
]

#: Bloom filters, MinHash and merges by rank are not SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
