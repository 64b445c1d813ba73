"""Write-side policies. They fold rows in order, so each partition's rows stream through one task."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def flush_rounds(df: DataFrame, partition: str, order: str, size: str, threshold: int) -> DataFrame:
    """Round in which each row leaves its buffer: a round closes with the row that reaches `threshold`.

    Rows of a partition arrive sorted and are folded as a stream: constant memory for any length.
    """
    ordered = df.select(partition, order, size).repartition(partition).sortWithinPartitions(partition, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, number = object(), 0, 0
        for batch in batches:
            parts, sizes, rounds = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for p, n in zip(parts, sizes, strict=True):
                if p != at:
                    at, held, number = p, 0, 0
                elif held >= threshold:
                    held, number = 0, number + 1
                held += n or 0
                rounds.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rounds, pa.int64())], names=[partition, order, "round"])

    types = dict(ordered.dtypes)
    return ordered.mapInArrow(run, f"`{partition}` {types[partition]}, `{order}` {types[order]}, round long")


def largest_first(df: DataFrame, task: str, order: str, partition: str, size: str, limit: int, share: float = 0.75) -> DataFrame:
    """Flushes of map tasks under a total limit: above `limit` x `share` the largest partition goes.

    The total is looked at only when a row leaves its partition no larger than the largest has been: a
    partition that has just become the largest gets no look, so a task may hold more than the valve by
    what those rows brought. What is left at the end of a task is flushed largest first. Ties go to the
    smaller partition id. Memory is one counter for each reduce partition of the task at hand; a heap
    with stale entries finds the largest. Memory that grows on request is the engine's affair.
    """
    ordered = df.select(task, order, partition, size).repartition(task).sortWithinPartitions(task, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, total, most = None, 0, 0, 0
        held: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        rows: list[tuple] = []

        def largest() -> int:
            while heap and held.get(heap[0][1]) != -heap[0][0]:
                heapq.heappop(heap)
            return -heap[0][0] if heap else 0

        def flush() -> None:
            nonlocal step, total, most
            largest()
            n, p = heapq.heappop(heap)
            del held[p]
            rows.append((at, step, p, -n))
            step, total, most = step + 1, total + n, largest()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)], names=["map_id", "step", "reduce_id", "n_bytes"])
            rows.clear()
            return made

        for batch in batches:
            for t, _, p, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if t != at:
                    while held:
                        flush()
                    at, step, total, most = t, 0, 0, 0
                    heap.clear()
                held[p] = held.get(p, 0) + (n or 0)
                total += n or 0
                heapq.heappush(heap, (-held[p], p))
                if held[p] > most:
                    most = held[p]
                elif total > limit * share:
                    flush()
            yield out()
        while held:
            flush()
        yield out()

    return ordered.mapInArrow(run, "map_id long, step long, reduce_id long, n_bytes long")


def sample_schedule(limit: int, growth: float = 1.1) -> list[int]:
    """Update numbers at which a size sample is due, up to `limit`."""
    out, due = [], 1
    while due <= limit:
        out.append(due)
        due = math.ceil(due * growth)
    return out
