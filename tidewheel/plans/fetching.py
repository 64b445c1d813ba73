"""Fetch planning: consecutive blocks of one reduce id packed into requests of limited size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fetch_plan(blocks: DataFrame, first: int, later: int) -> DataFrame:
    """(reduce_id, map_id, len) -> (r, m, req, off, n).

    The first request of a reduce id holds `first` bytes, later ones `later`; a block that crosses a
    limit is split. Empty blocks take no part, so no request spans two reduce ids and sizes add up.
    """
    w = Window.partitionBy("reduce_id").orderBy("map_id").rowsBetween(Window.unboundedPreceding, 0)
    at = blocks.where("len > 0").withColumn("en", F.sum("len").over(w)).withColumn("st", F.col("en") - F.col("len"))

    def request(x):
        return F.when(x < first, F.lit(0)).otherwise(1 + F.floor((x - first) / later)).cast("long")

    each = at.withColumn("req", F.explode(F.sequence(request(F.col("st")), request(F.col("en") - 1))))
    low = F.when(F.col("req") == 0, F.lit(0)).otherwise(first + (F.col("req") - 1) * later)
    high = first + F.col("req") * later
    start = F.greatest("st", low)
    return each.select(F.col("reduce_id").alias("r"), F.col("map_id").alias("m"), "req", (start - F.col("st")).alias("off"), (F.least("en", high) - start).alias("n"))
