"""Packing by best-fit decreasing.

Each task packs what it scans, so no text and no id is shuffled. Overlong documents first give full
windows. What is left of them is kept until a block of `block_tokens` has come together (or the
partition ends), then placed in order of decreasing length: a segment tree over remaining capacities
finds the tightest open window that holds the piece. Windows that stay more than `slack` short are
opened again: their pieces are laid end to end and cut into full windows, and the last rest is cut at
powers of two, lengths that need no padding. Blocks bound memory; they hold thousands of windows, so
what they lose to padding does not depend on the size of the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewheel.llm.arrow import map_batches
from tidewheel.llm.bpe import byte_bpe
from tidewheel.sources.tables import table

SCHEMA = StructType([StructField(c, LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
#: Local sequence numbers below this bit, the partition above.
LOCAL_BITS = 36


class CapacityTree:
    """Open windows by remaining capacity; a segment tree of counts answers "tightest that holds n"."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves < size + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at //= 2

    def take(self, length: int) -> tuple[int, int] | None:
        """Window of the least capacity that is at least `length`, removed; None if there is none."""
        count, at = self.count, length + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        window = self.windows[capacity].pop()
        while at:
            count[at] -= 1
            at //= 2
        return capacity, window


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows of at most `size`, each a list of positions in `lengths`. Ties keep the given order."""
    tree, windows = CapacityTree(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if found := tree.take(lengths[i]):
            capacity, w = found
        else:
            capacity, w = size, len(windows)
            windows.append([])
        windows[w].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], w)
    return windows


def pack_block(pieces: list[tuple[int | None, int, bytes, int]], size: int, slack: int) -> Iterator[list[tuple[int | None, int, bytes, int]]]:
    """Sequences, as lists of (doc, start, ids, doc_tokens), that hold each id of `pieces` once."""
    lengths = [len(p[2]) // 4 for p in pieces]
    loose = []
    for window in best_fit_decreasing(lengths, size):
        if size - sum(lengths[i] for i in window) <= slack:
            yield [pieces[i] for i in window]
        else:
            loose += [pieces[i] for i in window]
    left, rest = sum(len(p[2]) // 4 for p in loose), []
    wants = [size] * (left // size) + [1 << b for b in reversed(range(size.bit_length())) if (left % size) >> b & 1]
    stream = iter(loose)
    for want in wants:
        sequence = []
        while want:
            doc, start, ids, total = rest.pop() if rest else next(stream)
            if (n := len(ids) // 4) > want:
                rest.append((doc, start + want, ids[4 * want :], total))
                ids, n = ids[: 4 * want], want
            sequence.append((doc, start, ids, total))
            want -= n
        yield sequence


def pack(df: DataFrame, tokenizer: tuple[str, str | None, str | None], size: int = 1024, end_id: int = 0, block_tokens: int = 1 << 21, slack: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts, how long it is and where it was laid.

    Null and empty texts are documents of the end id alone; very long ones are cut into full windows
    first. Repeated rows and repeated or null ids are
    packed as documents of their own. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(*tokenizer), end_id.to_bytes(4, "little")
        sequence_id = TaskContext.get().partitionId() << LOCAL_BITS
        pieces, waiting, rows = [], 0, []

        def lay(sequence) -> None:
            nonlocal sequence_id
            offset = 0
            for doc, start, ids, total in sequence:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence_id, offset))
                offset += n
            sequence_id += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(SCHEMA)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=SCHEMA.fieldNames())

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(value.as_py() or "") + end
                total = len(ids) // 4
                full = total - total % size
                for start in range(0, full, size):
                    lay([(doc, start, ids[4 * start : 4 * (start + size)], total)])
                if total > full:
                    pieces.append((doc, full, ids[4 * full :], total))
                    waiting += total - full
                if waiting >= block_tokens:
                    for sequence in pack_block(pieces, size, slack):
                        lay(sequence)
                    pieces, waiting = [], 0
                if len(rows) >= 50_000:
                    yield flush()
        for sequence in pack_block(pieces, size, slack):
            lay(sequence)
        yield flush()

    return df.select(F.col(doc_id).cast("long"), text).transform(map_batches, run, SCHEMA)


def gpt_bytes() -> tuple[str, str, str]:
    """The public byte-level tokenizer: file of the library, ranks of the same vocabulary, pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of a row of `documents` in sequences of at most 1024 ids: where it starts, how long it is, the
    crc32 of its ids, how many the document has, and the sequence and offset where it lies."""
    return pack(table(spark, sf_dir, "documents"), gpt_bytes())
