"""Shared scratch space for lineage cuts.

`spark.checkpoint.dir` names the folder on a cluster. Only where it is unset (tests, notebooks) a
local folder takes its place, and then only if the session runs in local mode. Everything goes below
one folder for each application, which `clean` deletes, at the latest when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_registered: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared scratch folder, set as the checkpoint directory of the context."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/tidewheel-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def application_dir(spark: SparkSession) -> str:
    """Folder of this application below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _registered:
        _registered.add(app)
        atexit.register(_at_exit, spark, app)
    return f"{shared_dir(spark)}/{app}"


def _at_exit(spark: SparkSession, app: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and context.applicationId == app:  # still running
        clean(spark)


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was something at `path`, which is gone now."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(context._jsc.hadoopConfiguration())
    return store.exists(place) and store.delete(place, True)


def clean(spark: SparkSession) -> bool:
    """Deletes all that this application left in the shared folder. DataFrames that read it are void from then on."""
    return delete(spark, application_dir(spark))


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path below the application's folder that nothing else uses."""
    return f"{application_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write `df` below the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._tidewheel_path = path
    return stored


def release(*stored: DataFrame) -> None:
    """Deletes what `materialise` wrote, once nothing that is still to run reads it."""
    for df in stored:
        delete(df.sparkSession, df._tidewheel_path)
