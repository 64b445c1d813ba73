"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.arrow import map_batches
from tidewheel.sources.shared import materialise

#: Nodes that a task joins at once before it passes them on.
AT_ONCE = 1 << 18


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars: each node of a component of them and its least node, AT_ONCE nodes at a time."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in root if root[x] != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(x, y)] = min(x, y)
        if len(root) >= AT_ONCE:
            yield stars()
    yield stars()


def settled(e: DataFrame) -> bool:
    """Whether no node has two parents or a parent that has one."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
    return odd.count() == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root): each node and the least node of its component.

    Tasks first join what they read to stars. Of a node's neighbours only the least is aggregated, so
    a node of many links costs a row for each, and never a list. Each round is written to the shared
    folder. Nodes without links, null ends and loops are left out. The number of rounds grows with
    the logarithm of the largest component.
    """
    stars = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).transform(map_batches, contract, "a long, b long")
    e = materialise(stars.distinct(), "edges")
    for _ in range(most_rounds):
        if settled(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
