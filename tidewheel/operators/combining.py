"""Combining values by key before and after the exchange."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> (what a map task makes of its values, how partial results merge). All merges are associative.
COMBINERS: dict[str, tuple[Callable[[Column], Column], Callable[[str], Column]]] = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}


def partial_runs(df: DataFrame, by: list[str], value: str, names: list[str]) -> DataFrame:
    """Combined records as map tasks emit them: one row for each group of `by`, a column for each combiner."""
    return df.groupBy(*by).agg(*[COMBINERS[n][0](value).alias(f"p_{n}") for n in names])


def merge_runs(partial: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Reduce side: partial records of a key, however many, become one."""
    return partial.groupBy(key).agg(*[COMBINERS[n][1](f"p_{n}").alias(n) for n in names])


def combine(df: DataFrame, key: str, value: str, names: list[str]) -> DataFrame:
    """Count, sum, min or max by key; Spark combines on the map side and again after the exchange."""
    return df.groupBy(key).agg(*[COMBINERS[n][0](value).alias(n) for n in names])


def gather(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """All values of a key as a sorted array: nothing to combine on the map side.

    An array is one row of the result, so a key's values must fit in a row; use `combine` where an
    aggregate is what is wanted.
    """
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))


def fold(df: DataFrame, key: str, zero: Column, value: Column, name: str) -> DataFrame:
    """Largest value by key, not less than `zero`."""
    return df.groupBy(key).agg(F.greatest(F.max(value), zero).alias(name))


def cogroup(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str) -> DataFrame:
    """Sorted values of both sides for every key of either; an absent side is an empty array."""
    a, b = gather(left, key, left_value, "left_values"), gather(right, key, right_value, "right_values")
    joined = a.join(b, key, "full")
    return joined.select(key, *[F.coalesce(c, F.array().cast(joined.schema[c].dataType)).alias(c) for c in ("left_values", "right_values")])
