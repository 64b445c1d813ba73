"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_code(size: Column, base: float = 1.1) -> Column:
    """One-byte logarithmic code of a size; 0 for an empty block."""
    code = F.least(F.lit(255), F.ceil(F.log(size.cast("double")) / F.log(F.lit(base))))
    return F.when(size <= 0, F.lit(0)).otherwise(code).cast("long")


def decoded_size(code: Column, base: float = 1.1) -> Column:
    """What a reader takes the size for; 0 stays 0."""
    return F.when(code == 0, F.lit(0)).otherwise(F.floor(F.pow(F.lit(base), code.cast("double")))).cast("long")
