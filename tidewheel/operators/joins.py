"""Joins on nearness: both sides are cut into bins, so they are equi-joins that adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, at: Column, other: Column, below: float, above: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with at - below <= other <= at + above and equal `on` columns; both values are numbers, and nulls join nothing.

    A bin is as wide as the band, so a left row looks into two bins and meets only rows within two
    widths of it. Columns of the two sides but for `on` must differ.
    """
    width = float(below + above) or 1.0
    bins = left.withColumn("__at", at.cast("double")).withColumn("__bin", F.explode(F.sequence(F.floor((F.col("__at") - below) / width), F.floor((F.col("__at") + above) / width))))
    binned = right.withColumn("__other", other.cast("double")).withColumn("__bin", F.floor(F.col("__other") / width))
    near = (F.col("__other") >= F.col("__at") - below) & (F.col("__other") <= F.col("__at") + above)
    return bins.join(binned, [*(on or []), "__bin"]).where(near).drop("__bin", "__at", "__other")
