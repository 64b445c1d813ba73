"""Session factory with the settings that exchanges rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.shuffle.checksum.enabled": "true",
    "spark.shuffle.detectCorrupt": "true",
}


def session(app: str = "tidewheel", **overrides: str) -> SparkSession:
    """Get or create a session; overrides use _ for . in names. Settings are validated before the start."""
    settings = DEFAULTS | {k.replace("_", "."): str(v) for k, v in overrides.items()}
    if settings.get("spark.shuffle.useOldFetchProtocol", "false") == "true":
        raise ValueError("exchange blocks are named by map attempt, which the old fetch protocol cannot express")
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
