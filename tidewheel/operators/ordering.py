"""Sorted delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.sources.shared import materialise


def sort_in_partitions(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Equal keys in one partition, each partition sorted: no total order, no single task."""
    return df.repartition(key).sortWithinPartitions(*(order or (key,)))


def ranked(df: DataFrame, *order: Column | str, within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rank inside each group of `within`, by a unique order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(within or [])).orderBy(*order)).cast("long"))


def globally_ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rank over the whole table without a one-task window; `order` should be unique.

    Rows move once: range-partitioned, sorted, numbered as each partition streams by, and written with
    their number (partition in the upper bits, row in the lower 33). A rank is the row's place plus the
    rows of the partitions before, one figure for each partition.
    """
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(numbered, "ranked")
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    # one row for each shuffle partition, so the small side is bounded by their number
    return placed.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + row + 1).drop("__p", "__at", "__before")
