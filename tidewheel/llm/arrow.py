"""Arrow plumbing shared by the operators that run Python on executors."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewheel.sources.tables import reach

#: Of one Arrow batch, in the JVM and in Python; one row may be more.
BATCH_BYTES = 2 << 20


def give_back() -> None:
    """Returns freed memory to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow with batches of BATCH_BYTES, unless the session says otherwise."""
    reach(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def map_columns(df: DataFrame, keep: list[str], inputs: dict[str, Column], add: StructType, make: Callable) -> DataFrame:
    """`keep` columns of `df` plus the columns of `add`, which Python computes batch by batch.

    `make()` runs once per task and returns f(*input arrays) -> list of arrays, one for each field of
    `add`. A kept column that has the name of an added one is replaced. `inputs` are evaluated by
    Spark and only they and the kept columns travel.
    """
    added = set(add.fieldNames())
    keep = [c for c in keep if c not in added]
    names = [f"__in{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(f"`{c}`") for c in keep], *[x.alias(n) for x, n in zip(inputs.values(), names, strict=True)])
    schema = StructType([StructField(f.name, f.dataType, True) for f in source.schema.fields[: len(keep)]] + add.fields)
    n_keep, n_in, out_names = len(keep), len(names), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if batch.num_rows:
                made = compute(*[batch.column(n_keep + i) for i in range(n_in)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *made], names=out_names)

    return map_batches(source, run, schema)


def slices(column: pa.Array, size: int = 1 << 20, most: int = 512) -> Iterator[list[str]]:
    """Texts as Python strings, null as empty, in lists of about `size` bytes at most (one text at least)."""
    begin, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > begin and (total + n > size or i - begin >= most):
            yield [x or "" for x in column.slice(begin, i - begin).to_pylist()]
            begin, total = i, 0
        total += n
    if begin < len(column):
        yield [x or "" for x in column.slice(begin).to_pylist()]


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """True for rows that no classifier may learn from: crc32 of the id as text leaves `rest`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))
