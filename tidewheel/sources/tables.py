"""Table access: every read goes through Spark, so any store Spark knows will do."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reach(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever the working directory."""
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table `name` below `sf_dir`."""
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
