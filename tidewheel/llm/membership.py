"""Filters of bounded size that tell which keys a set may hold. They only ever save work: whatever
passes wrongly is sorted out by a join later, so a filter that fills up costs time, not results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.arrow import map_batches
from tidewheel.llm.texts import STEP, mix

SEGMENTS = 64
MOST_BITS = 1 << 28  # 32 MB


class Filter:
    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 // SEGMENTS - 1)
        self.size = len(words) * 64 // SEGMENTS

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in _places(keys, self.mask, self.size):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _places(keys: np.ndarray, mask: np.uint64, size: int) -> list[np.ndarray]:
    """Two bits for each key, in the segment that its highest bits name."""
    base = (keys >> np.uint64(58)) * np.uint64(size)
    other = mix(keys * STEP)
    return [base + (keys & mask), base + (other & mask)]


def build(keys: DataFrame) -> Filter:
    """Filter of one column of well-mixed longs: 16 bits a key, MOST_BITS at most. One segment a row reaches the driver."""
    n = keys.count()
    bits = 1 << 16
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    size, mask = bits // SEGMENTS, np.uint64(bits // SEGMENTS - 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}
        for batch in batches:
            k = np.asarray(batch.column(0)).view(np.uint64)
            which = (k >> np.uint64(58)).astype(int)
            for s in np.unique(which):
                own = segments.setdefault(int(s), np.zeros(size, bool))
                for at in _places(k[which == s], mask, 0):
                    own[at] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in segments.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(segments), pa.int32()), pa.array(packed, pa.binary())], names=["segment", "bits"])

    column = keys.columns[0]
    dealt = keys.select(column).repartition(F.shiftrightunsigned(column, 58))
    words = np.zeros(bits // 64, np.uint64)
    for r in dealt.transform(map_batches, fill, "segment int, bits binary").collect():
        at = r["segment"] * size // 64
        words[at : at + size // 64] |= np.frombuffer(r["bits"], np.uint64)
    return Filter(words)
