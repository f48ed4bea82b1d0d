"""Filters, listings, splits and set operations that queries are put together from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import sample_order
from graphloom.operators.order import numbered


def equals_any(filters: dict[str, list]) -> Column:
    """Each field equals one of its values; fields without values ask for nothing."""
    return reduce(lambda a, b: a & b, [reduce(lambda x, y: x | y, [F.col(c) == v for v in values]) for c, values in filters.items() if values], F.lit(True))


def contains(column: str, text: str) -> Column:
    """The text stands in the value, whatever its case."""
    return F.col(column).ilike("%" + _escaped(text) + "%")


def starts_with(column: str, text: str) -> Column:
    return F.col(column).ilike(_escaped(text) + "%")


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def visible(run_ts: str, impl_ts: str, at: str, newer_results: bool = False, newer_impls: bool = False) -> Column:
    """What was known at a time: older runs, or with ``newer_results`` all; with ``newer_impls`` also runs of implementations that came later."""
    seen = F.lit(newer_results) | (F.col(run_ts) < F.to_timestamp(F.lit(at)))
    return seen | (F.lit(newer_impls) & (F.col(impl_ts) > F.to_timestamp(F.lit(at))))


def display_name(pretty: str, name: str, overrides: dict | None = None, key: str | None = None) -> Column:
    """The override for the key, else the pretty name, else the name."""
    shown = F.coalesce(F.col(pretty), F.col(name))
    if overrides and key:
        table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
        shown = F.coalesce(F.try_element_at(table, F.col(key)), shown)
    return shown


def list_entities(df: DataFrame, filters: dict[str, list] | None = None, like: dict[str, str] | None = None, sort: list[tuple[str, bool]] | None = None, key: str = "id", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows that fit, in the wanted order (columns of the table only; else by ``key``), paged."""
    for c, _ in sort or []:
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    out = df.where(equals_any(filters or {}))
    for c, text in (like or {}).items():
        out = out.where(contains(c, text))
    out = out.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in sort or [(key, True)]], key)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def random_split(df: DataFrame, key: str, seed: int, count: int) -> tuple[DataFrame, DataFrame]:
    """The first ``count`` rows in a seeded random order, and the rest."""
    placed = numbered(df.withColumn("_order", sample_order(seed, 0, key)), ["_order", key], "_rn").drop("_order")
    return placed.where(F.col("_rn") <= count).drop("_rn"), placed.where(F.col("_rn") > count).drop("_rn")


def single_row(df: DataFrame, optional: bool = False):
    """The only row; none if ``optional``. Anything else is an error."""
    found = df.limit(2).collect()
    if len(found) == 1:
        return found[0]
    if not found and optional:
        return None
    raise LookupError("no row" if not found else "more than one row")


def ends(df: DataFrame, order: str, key: str, n: int = 3) -> DataFrame:
    """The first and the last n rows of an order, with their side."""
    first = df.orderBy(order, key).limit(n).withColumn("side", F.lit("first"))
    last = df.orderBy(F.desc(order), F.desc(key)).limit(n).withColumn("side", F.lit("last"))
    return first.unionByName(last)


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, each by its weight: least of -ln(u) / weight with u from a hash of the key."""
    u = (F.conv(F.substring(sample_order(seed, 7, key), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    return df.where(F.col(weight) > 0).withColumn("_place", -F.log(u) / F.col(weight)).orderBy("_place", key).limit(n).drop("_place")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other has not; empty if they are equal as sets."""
    return a.union(b).distinct().subtract(a.intersect(b))


def latest_valid(value: str, partition: list[str], order: str) -> Column:
    """The last non-null value up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def table_columns(df: DataFrame) -> DataFrame:
    """(position, name) of a table's columns."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position long, name string")
