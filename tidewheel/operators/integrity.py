"""Checks of a stored exchange against its manifest of (map_id, reduce_id, n_bytes, checksum)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ["map_id", "reduce_id"]


def block_statistics(df: DataFrame, width: int = 100) -> DataFrame:
    """Records and bytes of each block that has rows; `width` bytes a record."""
    return df.groupBy(*BLOCK).agg(F.count("*").alias("n_records"), (F.count("*") * width).alias("n_bytes"))


def full_grid(blocks: DataFrame, maps: int, reduces: int) -> DataFrame:
    """Every block of the grid; those without rows have zero records and bytes."""
    spark = blocks.sparkSession
    cells = spark.range(maps * reduces).select(F.floor(F.col("id") / reduces).alias("map_id"), (F.col("id") % reduces).alias("reduce_id"))
    return cells.join(blocks, BLOCK, "left").fillna(0, ["n_records", "n_bytes"])


def short_blocks(found: DataFrame, manifest: DataFrame, tolerance: float = 1.1) -> DataFrame:
    """Blocks whose bytes, stretched by the tolerance of a lossy size, do not reach what was published."""
    joined = manifest.select(*BLOCK, F.col("n_bytes").alias("expected")).join(found.select(*BLOCK, F.col("n_bytes").alias("actual")), BLOCK, "left")
    return joined.withColumn("actual", F.coalesce("actual", F.lit(0))).where(F.col("actual") * tolerance < F.col("expected"))


def unmatched_blocks(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Blocks that only one side has, and which side lacks them."""
    a, b = manifest.where("n_bytes > 0").select(*BLOCK), found.select(*BLOCK).distinct()
    missing = a.join(b, BLOCK, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(b.join(a, BLOCK, "left_anti").withColumn("problem", F.lit("unlisted")))


def duplicate_blocks(listed: DataFrame) -> DataFrame:
    """Blocks that a listing names more than once."""
    return listed.groupBy(*BLOCK).agg(F.count("*").alias("n")).where("n > 1")


def block_checksums(df: DataFrame, checksum: Column) -> DataFrame:
    """Order-free checksum of each block: the sum of its rows' values."""
    return df.groupBy(*BLOCK).agg(F.sum(checksum).cast("long").alias("checksum"))


def corrupt_blocks(found: DataFrame, manifest: DataFrame) -> DataFrame:
    joined = manifest.select(*BLOCK, F.col("checksum").alias("expected")).join(found.select(*BLOCK, F.col("checksum").alias("actual")), BLOCK)
    return joined.where("expected <> actual")


def committed(attempts: DataFrame) -> DataFrame:
    """Rows of the last committed attempt of each map; other attempts stay invisible.

    The manifest is one row for each attempt, so the window never holds a map's data.
    """
    last = attempts.where("committed").select("map_id", "attempt").distinct()
    newest = last.withColumn("k", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("attempt")))).where("k = 1").drop("k")
    return attempts.where("committed").join(newest, ["map_id", "attempt"], "left_semi")
