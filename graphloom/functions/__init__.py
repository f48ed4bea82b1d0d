"""Column builders: scalar, aggregate and window functions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids that stand for no implementation of the warehouse.
OPTIMAL, BEST_NON_SWITCHING, FIRST_PREDICTOR = -1, -2, -3
#: Level of a vertex that breadth-first search does not reach.
UNREACHED = 2147483647


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def min_key(key: Column | str, *values: Column | str) -> Column:
    """Aggregate: the key of the least tuple of values, compared one after the other; nulls are greatest, ties go to the smaller key."""
    order = [x for v in values for x in (_col(v).isNull(), _col(v))]
    return F.min_by(_col(key), F.struct(*[x.alias(f"o{i}") for i, x in enumerate([*order, _col(key)])]))


def check_unique(value: Column | str) -> Column:
    """Aggregate: the value if there is one distinct non-null value, else null."""
    return F.when(F.min(_col(value)) == F.max(_col(value)), F.max(_col(value)))


def total(value: Column | str) -> Column:
    """Aggregate: the sum as double, 0.0 where there is nothing to add."""
    return F.coalesce(F.sum(_col(value).cast("double")), F.lit(0.0))


def count_transitions(value: Column | str, partition: Iterable[str], order: Iterable[Column | str]) -> Column:
    """Window: how often the value changes in the order, the first row included. Nulls equal each other."""
    by = Window.partitionBy(*partition).orderBy(*order)
    changed = (F.row_number().over(by) == 1) | ~_col(value).eqNullSafe(F.lag(_col(value)).over(by))
    return F.when(changed, 1).otherwise(0).cast("long")


def sample_order(seed: int, stream: int, *keys: Column | str) -> Column:
    """A value that orders keys at random, the same in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), *[_col(k).cast("string") for k in keys]))


def hash_number(seed: int, stream: int, *keys: Column | str) -> Column:
    """A number from 0 to 2^60 - 1 by the hash of keys, the same in any engine with md5."""
    return F.conv(F.substring(sample_order(seed, stream, *keys), 1, 15), 16, 10).cast("long")


def running_total(value: Column | str, partition: Iterable[str], order: Iterable[Column | str]) -> Column:
    """Window: the sum of the value up to the row, null values as nothing."""
    upto = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.sum(_col(value)).over(upto), F.lit(0))


def select_sample(df: DataFrame, key: str, seed: int, stream: int, amount: int | float) -> DataFrame:
    """``df`` with ``keep``: true for exactly ``amount`` distinct keys, or for floor(amount * N) of N if it is a float from 0 to 1.

    The distinct keys are numbered in the order of one hash each, sorted by ranges: only the key at the cut reaches the driver.
    """
    if isinstance(amount, float) and not 0 <= amount <= 1:
        raise ValueError(f"fraction {amount} is outside 0..1")
    from graphloom.operators.order import numbered

    placed = numbered(df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_order", sample_order(seed, stream, key)), ["_order", key], "_rn")
    n = int(amount * placed.count()) if isinstance(amount, float) else min(amount, placed.count())
    if n <= 0:
        return df.withColumn("keep", F.lit(False))
    last = placed.where(F.col("_rn") == n).first()
    mine = F.struct(sample_order(seed, stream, key).alias("_order"), F.col(key).alias("k"))
    return df.withColumn("keep", F.coalesce(mine <= F.struct(F.lit(last["_order"]).alias("_order"), F.lit(last[key]).alias("k")), F.lit(False)))


def few_values(df: DataFrame, column: str, most: int = 100_000) -> list:
    """The distinct values of a small dimension's column in order; more than ``most`` are an error, and no more than that reach the driver."""
    found = [r[0] for r in df.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}")
    return found


def dense_vector(keys: DataFrame, facts: DataFrame, on: list[str], key: str, value: str, default: float, latest: str | None = None) -> DataFrame:
    """For each group ``on`` of ``facts`` a vector of (key, value) over all ``keys`` in their order; missing values are ``default``.

    Several values of a key: that with the greatest ``latest``, or the greatest value. ``keys`` is a small dimension; it is collected within
    the bound of ``few_values``, so that vectors are built in one aggregation without a cross join.
    """
    all_keys = few_values(keys, key)
    pick = F.max_by(value, latest) if latest else F.max(value)
    one = facts.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(*on, key).agg(pick.alias("_value"))
    have = one.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct(key, "_value"))).alias("_have"))
    slots = F.array(*[F.lit(k) for k in all_keys]).cast(T.ArrayType(keys.schema[key].dataType))
    made = F.transform(slots, lambda k: F.struct(k.alias("key"), F.coalesce(F.col("_have")[k].cast("double"), F.lit(default)).alias("value")))
    return facts.select(*on).distinct().join(have, on, "left").withColumn("vector", made).drop("_have")


def greatest_or_null(*values: Column | str) -> Column:
    """The greatest value; null if any is null."""
    some = reduce(lambda a, b: a | b, [_col(v).isNull() for v in values])
    return F.when(~some, F.greatest(*[_col(v) for v in values]))


def percentage(value: Column | str) -> Column:
    """A part of 1 as per cent with two decimals."""
    return F.format_string("%.2f%%", _col(value) * 100)


def triangle_row(index: Column | str) -> Column:
    """The row of an index that counts the cells of a lower triangle row by row."""
    guess = F.floor((F.sqrt(8.0 * _col(index) + 1) - 1) / 2).cast("long")
    # the root may be off by one beyond 2^52
    return guess + F.when((guess + 1) * (guess + 2) / 2 <= _col(index), 1).otherwise(0) - F.when(guess * (guess + 1) / 2 > _col(index), 1).otherwise(0)


def in_intervals(value: Column | str, intervals: str) -> Column:
    """Whether a number lies in a list like ``5-10,13,17-20``."""
    parts = [p.strip().split("-") for p in intervals.split(",") if p.strip()]
    return reduce(lambda a, b: a | b, [_col(value).between(int(p[0]), int(p[-1])) for p in parts], F.lit(False))


def masked_float(value: Column | str, bits: int = 16) -> Column:
    """A value as 32-bit float whose lowest ``bits`` of the significand are cleared."""
    @F.pandas_udf("float")
    def mask(x: pd.Series) -> pd.Series:
        raw = x.to_numpy(np.float32).view(np.uint32) & np.uint32((0xFFFFFFFF << bits) & 0xFFFFFFFF)
        return pd.Series(raw.view(np.float32))

    return mask(_col(value).cast("float"))
