"""Durable exchanges: map output in a shared store, laid out by reduce id, sorted by map id inside.

Each attempt writes its rows below `data/attempt=<n>` and then, as its commit, what it sent of each
block below `manifest/attempt=<n>`: records, bytes and checksum. Readers see, of each map, the last
attempt that the manifest has; one that never committed stays invisible. Range reads prune folders by
reduce id and row groups by map id. A reduce id has as many files as its size asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidewheel.operators import integrity
from tidewheel.sources.shared import application_dir, delete, fresh_path

#: Maps whose last attempts are broadcast to readers; those of more are joined.
FEW_MAPS = 1_000_000


@dataclass
class Exchange:
    """One registered exchange: `reduces` partitions below `path`."""

    spark: SparkSession
    path: str
    reduces: int
    schema: StructType | None = None

    def write(self, df: DataFrame, reduce_id: Column, map_id: Column, attempt: int = 0, size: Column | None = None, sent: DataFrame | None = None, commit: bool = True) -> Exchange:
        """Store the rows of one attempt of the maps in `df` and, unless it failed (`commit` false), publish their blocks.

        `size` is the bytes of a row, eight a column by default. The manifest counts `sent`, `df` itself
        by default, not what the store holds, so that a damaged store shows.
        """
        ids = {"reduce_id": reduce_id.cast("long"), "map_id": map_id.cast("long")}
        placed = df.withColumns(ids)
        rest = [f for f in placed.schema.fields if f.name not in ids]
        self.schema = StructType([*rest, StructField("map_id", LongType()), StructField("attempt", IntegerType()), StructField("reduce_id", LongType())])
        placed.hint("rebalance", "reduce_id").sortWithinPartitions("reduce_id", "map_id").write.partitionBy("reduce_id").parquet(f"{self.path}/data/attempt={attempt}")
        if commit:
            listed = self.statistics(placed if sent is None else sent.withColumns(ids), size)
            listed.coalesce(1).write.parquet(f"{self.path}/manifest/attempt={attempt}")  # a row for each block
        return self

    def statistics(self, df: DataFrame, size: Column | None = None) -> DataFrame:
        columns = [f.name for f in self.schema.fields if f.name not in ("map_id", "reduce_id", "attempt")]
        size = F.lit(8 * len(columns)) if size is None else size
        return df.groupBy("map_id", "reduce_id").agg(F.count("*").alias("n_records"), F.sum(size).cast("long").alias("n_bytes"), F.bit_xor(F.xxhash64(*columns)).alias("checksum"))

    def manifest(self) -> DataFrame:
        """(map_id, reduce_id, n_records, n_bytes, checksum, attempt) of the last committed attempt of each map."""
        listed = self.spark.read.parquet(f"{self.path}/manifest")
        return integrity.committed(listed.withColumn("committed", F.lit(True))).drop("committed")

    def read(self, start: int = 0, end: int | None = None, start_map: int | None = None, end_map: int | None = None) -> DataFrame:
        """Reduce partitions [start, end) of all maps, or of maps [start_map, end_map)."""
        df = self.spark.read.schema(self.schema).parquet(f"{self.path}/data")
        df = df.where((F.col("reduce_id") >= start) & (F.col("reduce_id") < (self.reduces if end is None else end)))
        if start_map is not None:
            df = df.where(F.col("map_id") >= start_map)
        if end_map is not None:
            df = df.where(F.col("map_id") < end_map)
        tried, listed = (self._attempts(f"{self.path}/{part}") for part in ("data", "manifest"))
        if len(listed) == 1:
            return df.where(F.col("attempt") == listed[0]).drop("attempt") if len(tried) > 1 else df.drop("attempt")
        last = self.manifest().select("map_id", "attempt").distinct()
        few = last.count() <= FEW_MAPS
        return df.join(F.broadcast(last) if few else last, ["map_id", "attempt"], "left_semi").drop("attempt")

    def problems(self, size: Column | None = None) -> DataFrame:
        """(map_id, reduce_id, problem): blocks of which the store holds too few bytes, other rows, none, or some that nobody sent."""
        listed, found = self.manifest(), self.statistics(self.read(), size)
        short = integrity.short_blocks(found, listed).where("actual > 0").select("map_id", "reduce_id", F.lit("short").alias("problem"))
        corrupt = integrity.corrupt_blocks(found, listed).select("map_id", "reduce_id", F.lit("corrupt").alias("problem"))
        return short.unionByName(corrupt).unionByName(integrity.unmatched_blocks(found, listed))

    def metrics(self, by: str) -> DataFrame:
        """Records, bytes and blocks that each map wrote (by `map_id`) or each reduce partition reads (by `reduce_id`)."""
        return self.manifest().groupBy(by).agg(F.sum("n_records").alias("records"), F.sum("n_bytes").alias("bytes"), F.count("*").alias("blocks"))

    def _attempts(self, path: str) -> list[int]:
        fs, place = self._path(path)
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(place) if "=" in s.getPath().getName()) if fs.exists(place) else []

    def _path(self, path: str | None = None):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path or self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def exists(self) -> bool:
        fs, path = self._path()
        return fs.exists(path)

    def unregister(self, remove: bool = True) -> bool:
        """Forget the exchange and delete its data; a second call is no error and says False."""
        return remove and delete(self.spark, self.path)


def register(spark: SparkSession, reduces: int, name: str | None = None) -> Exchange:
    """An exchange in the shared folder: a new one, or the one of that name, which all who ask for it share.

    Whoever comes first makes it; a number of partitions below 1, or other than it was made with, is refused.
    """
    if reduces < 1:
        raise ValueError("an exchange needs at least one reduce partition")
    found = Exchange(spark, fresh_path(spark, "exchange") if name is None else f"{application_dir(spark)}/exchange-{name}", reduces)
    fs, mark = found._path(f"{found.path}/_reduces/{reduces}")
    fs.mkdirs(mark)
    if len(fs.listStatus(mark.getParent())) > 1:
        fs.delete(mark, True)
        raise ValueError(f"exchange {name} has another number of reduce partitions")
    return found
