"""Changes of warehouse tables as DataFrames, and checks of their keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import few_values


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` take the place of rows with their key; others are added."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table with rows of unknown keys, and the rows whose key is held with other values (an error to its caller)."""
    fresh = rows.join(table.select(*key), key, "left_anti")
    return table.unionByName(fresh), rows.select(*table.columns).subtract(table).join(table.select(*key), key, "left_semi")


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; unknown counts as not true."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def backfill(table: DataFrame, source: DataFrame, key: list[str], values: Iterable[str]) -> DataFrame:
    """Columns taken from a joined table where it has the key."""
    new = source.select(*key, *[F.col(v).alias(f"_{v}") for v in values])
    joined = table.join(new, key, "left")
    return joined.withColumns({v: F.coalesce(F.col(f"_{v}"), F.col(v)) for v in values}).drop(*[f"_{v}" for v in values])


def new_variants(graphs: DataFrame, configs: DataFrame, variants: DataFrame) -> DataFrame:
    """(graph_id, config_name) pairs that have no variant yet; configurations are few."""
    names = few_values(configs, "config_name")
    pairs = graphs.select("graph_id").withColumn("config_name", F.explode(F.array(*[F.lit(n) for n in names])))
    return pairs.join(variants.select("graph_id", "config_name"), ["graph_id", "config_name"], "left_anti")


def duplicate_keys(table: DataFrame, key: list[str]) -> DataFrame:
    return table.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows whose foreign key (child column: parent column) is not null and has no parent."""
    renamed = parent.select(*[F.col(p).alias(c) for c, p in columns.items()])
    return child.dropna(subset=list(columns)).join(renamed, list(columns), "left_anti")


def several_defaults(table: DataFrame, by: str, flag: str) -> DataFrame:
    """Groups with more than one default."""
    return table.where(F.col(flag)).groupBy(by).agg(F.count("*").alias("defaults")).where("defaults > 1")


def translate_ids(rows: DataFrame, column: str, old: DataFrame, new: DataFrame, natural: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Foreign keys of another database by natural key: the rows under new ids, and those without a counterpart."""
    mapping = old.select(F.col(key).alias(column), *natural).join(new.select(F.col(key).alias("_new"), *natural), natural).select(column, "_new")
    return rows.join(mapping, column).withColumn(column, F.col("_new")).drop("_new"), rows.join(mapping, column, "left_anti")
