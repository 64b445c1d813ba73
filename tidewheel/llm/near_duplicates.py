"""Near-duplicates by consistent weighted sampling.

Shingles of five words are weighted by TF-IDF. Document frequencies are counted over all documents by
whole hash: parts of the hash range count them and send each block of documents its own. Improved consistent weighted sampling draws BANDS x ROWS samples from
each distinct text; two texts share one with the probability of their weighted Jaccard similarity.
Texts that agree on a whole band are candidates, and the exact weighted similarity decides.

Candidates of a band key are never paired with each other at large. A round compares the members of a
key with a few pivots. A member within reach of a pivot is linked to it; as 1 - similarity is a
metric, it can be left aside once it is closer to that pivot than any unlinked member could bridge.
Rounds go on until each key is one component or all its members were pivots, so no link that would
connect anything more is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.arrow import map_batches
from tidewheel.llm.components import components
from tidewheel.llm.membership import build
from tidewheel.llm.texts import STEP, buffers, byte_slices, mix, shingles, words
from tidewheel.sources.shared import materialise, release
from tidewheel.sources.tables import table

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
BLOCK = 1 << 21
PART_BYTES = 16 << 20
LEAST_PARTS = 8
LINKED = SIMILAR - 1e-12
PIVOTS = 1024
PIVOT_BYTES = 16 << 20
MEMBERS = 1024

_rng = np.random.default_rng(17)
_SEEDS = mix(_rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * STEP)
_R = _rng.gamma(2.0, 1.0, 4096).astype(np.float32)
_INVERSE_R = (1 / _R).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 4096)).astype(np.float32)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def weighed(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of text, the text, and how often it has them."""
    found, of = shingles(*words(data, at), width)
    if not len(found):
        return found, of, np.zeros(0, np.int64)
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    first = np.concatenate([[True], (found[1:] != found[:-1]) | (of[1:] != of[:-1])])
    starts = np.flatnonzero(first)
    return found[starts], of[starts], np.diff(np.append(starts, len(found)))


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, docs, bytes, z): runs of (id, h, t) rows, compressed. Numbers of blocks hold only once they are written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, task, n = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for begin, end in byte_slices(batch.column(2), BLOCK):
                sink, own = pa.BufferOutputStream(), batch.slice(begin, end - begin)
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_batch(own)
                size = pc.sum(pc.binary_length(own.column(2))).as_py()
                yield pa.RecordBatch.from_pydict({"block": [task + n], "docs": [own.num_rows], "bytes": [size], "z": [squeeze(sink.getvalue().to_pybytes())]})
                n += 1

    return docs.transform(map_batches, cut, "block long, docs long, bytes long, z binary")


def opened(z: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(z)).read_next_batch()


def weighed_slices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """`weighed` of slices that stay in cache, and the number of texts of each."""
    return [(*weighed(*buffers(column.slice(begin, end - begin))), end - begin) for begin, end in byte_slices(column)]


def shrunk(values: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending values as the lower six bytes of each step, and the upper two, which are mostly 0, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    upper = (steps >> np.uint64(48)).astype("<u2")
    return steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), zstandard.ZstdCompressor(level=1).compress(upper.tobytes())


def restored(lower: bytes, upper: bytes) -> np.ndarray:
    steps = np.zeros((len(lower) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(lower, np.uint8).reshape(-1, 6)
    steps[:, 6:] = np.frombuffer(zstandard.ZstdDecompressor().decompress(upper), np.uint8).reshape(-1, 2)
    return np.cumsum(steps.view("<u8").ravel())


def document_frequencies(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, part, z): for each block the documents of all blocks that have its distinct shingles, in order of part and hash.

    Each shingle is counted by its whole hash in the part of the hash range that it falls in.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for block, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                every = [w[0] for w in weighed_slices(opened(z.as_py()).column(2))]
                found, times = np.unique(np.concatenate(every), return_counts=True)
                if not len(found):
                    continue
                part = ((found >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(found)]
                ranges = list(zip(at, at[1:], strict=False))
                lower, upper = zip(*[shrunk(found[a:b]) for a, b in ranges], strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[at[:-1]]), pa.array([block] * len(ranges), pa.int64()), pa.array(lower, pa.binary()), pa.array(upper, pa.binary()),
                    pa.array([squeeze(times[a:b].astype(np.int32).tobytes()) for a, b in ranges], pa.binary()),
                ], names=["part", "block", "lower", "upper", "times"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for run in groups(batches, 1):
            own = [restored(x.as_py(), y.as_py()) for x, y in zip(run.column(2), run.column(3), strict=True)]
            times = np.concatenate([np.frombuffer(expand(x.as_py()), np.int32) for x in run.column(4)])
            _, which = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(which, times).astype(np.int32)[which]
            ends = np.cumsum([len(x) for x in own])[:-1]
            z = pa.array([squeeze(x.tobytes()) for x in np.split(total, ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([run.column(1), run.column(0), z], names=["block", "part", "z"])

    dealt = blocks.select("block", "z").transform(map_batches, deal, "part long, block long, lower binary, upper binary, times binary")
    return dealt.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part").transform(map_batches, add, "block long, part long, z binary")


def inverse_frequencies(documents: int, frequencies: np.ndarray) -> np.ndarray:
    return np.log1p(max(1, documents) / np.maximum(frequencies, 1)).astype(np.float32)


def band_keys(found: np.ndarray, of: np.ndarray, weights: np.ndarray, texts: int) -> list[np.ndarray | None]:
    """BANDS keys of each text; None where a text has no shingle."""
    if not len(found):
        return [None] * texts
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    samples = np.empty((BANDS * ROWS, len(starts)), np.uint64)
    step = 1 << 16
    edges = [0]
    while edges[-1] < len(starts):  # blocks of whole texts that stay in cache
        edges.append(max(edges[-1] + 1, int(np.searchsorted(starts, starts[edges[-1]] + step))))
    log_w = np.log(weights)
    for a, b in zip(edges, edges[1:], strict=False):
        lo, hi = starts[a], starts[b] if b < len(starts) else len(found)
        h, lw, cuts = found[lo:hi], log_w[lo:hi], starts[a:b] - lo
        for k, seed in enumerate(_SEEDS):
            z = (h ^ seed) * _ODD
            z ^= z >> np.uint64(32)
            i = (z & np.uint64(4095)).astype(np.intp)
            beta = ((z >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
            r = _R[i]
            t = np.floor(lw * _INVERSE_R[i] + beta)
            log_a = _LOG_C[((z >> np.uint64(12)) & np.uint64(4095)).astype(np.intp)] - r * (t - beta + 1)
            bits = log_a.view(np.uint32)
            rank = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))
            name = (z >> np.uint64(32)).astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(2654435761))
            samples[k, a:b] = np.minimum.reduceat(rank.astype(np.uint64) << np.uint64(32) | name, cuts)
    keys = np.zeros((BANDS, len(starts)), np.uint64)
    for k in range(BANDS * ROWS):
        keys[k // ROWS] = mix(keys[k // ROWS] * STEP ^ samples[k])
    out: list[np.ndarray | None] = [None] * texts
    for j, text in enumerate(of[starts]):
        out[text] = keys[:, j].view(np.int64)
    return out


Vector = tuple[np.ndarray, np.ndarray, float]


def vectors(texts: list[str], idf: np.ndarray) -> list[Vector]:
    """Vectors of texts by the inverse frequencies of their distinct shingles, in order."""
    found, of, times = weighed(*buffers(pa.array(texts, pa.large_string())))
    w = (times.astype(np.float32) * idf).astype(np.float64)
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    return [(found[a:b], w[a:b], float(w[a:b].sum())) for a, b in zip(ends, ends[1:], strict=False)]


def weighted_jaccard(a: Vector, b: Vector) -> float:
    """Sum of lesser over sum of greater weights; 0 if neither text has a shingle."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = float(np.minimum(a[1][at[same]], b[1][same]).sum()) if same.any() else 0.0
    total = a[2] + b[2] - both
    return both / total if total > 0 else 0.0


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree on the first `keys` columns (longs), from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(i)) for i in range(keys)])
        starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if held and (a or any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys))):
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


class Pivots:
    """Vectors by shingle, so that one look-up compares a vector with all of them."""

    def __init__(self, own: list[Vector]):
        found = np.concatenate([v[0] for v in own]) if own else np.zeros(0, np.uint64)
        order = np.argsort(found, kind="stable")
        self.names, first = np.unique(found[order], return_index=True)
        self.at = np.append(first, len(found))
        self.of = np.repeat(np.arange(len(own)), [len(v[0]) for v in own])[order]
        self.weights = np.concatenate([v[1] for v in own])[order] if own else np.zeros(0)
        self.totals = np.array([v[2] for v in own])

    def similarity(self, v: Vector) -> np.ndarray:
        """Weighted Jaccard similarity of `v` to each pivot."""
        if not len(self.names):
            return np.zeros(len(self.totals))
        at = np.minimum(np.searchsorted(self.names, v[0]), len(self.names) - 1)
        same = self.names[at] == v[0]
        at, w = at[same], v[1][same]
        n = self.at[at + 1] - self.at[at]
        rows = np.repeat(self.at[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.of[rows], np.minimum(self.weights[rows], np.repeat(w, n)), len(self.totals))
        either = self.totals + v[2] - both
        return np.divide(both, either, out=np.zeros(len(both)), where=either > 0)


def links(active: DataFrame, texts: DataFrame, documents: int) -> DataFrame:
    """Links (a, b) at distance d, a > b, that connect all similar members of each key: (key, id, size) rows, (id, z, f)
    compressed texts and document frequencies of their distinct shingles.

    Keys of few members are compared at once, all members being pivots. A larger key starts with one
    pivot. From then on only members outside the component that most of the key belongs to can still
    add a connection, so they are the pivots that all others are compared with, PIVOTS at a time and
    PIVOT_BYTES of text, one pivot at least.
    """
    sizes = active.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.sum("size").alias("bytes"))
    few = (F.col("n") <= PIVOTS) & (F.col("bytes") <= PIVOT_BYTES)
    state = active.join(sizes, "key").select("key", "id", "size", "n", (few | (F.col("id") == F.col("low"))).alias("pivot"), (~few).alias("more"))
    found: DataFrame | None = None
    while True:
        parts = F.ceil(F.col("n") / MEMBERS)
        chosen = state.where("pivot").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumn("tag", F.lit(0).cast("long"))
        others = state.where("NOT pivot").withColumn("part", F.pmod(F.xxhash64("id"), parts)).withColumn("tag", F.when(F.col("more"), 1).otherwise(2).cast("long"))
        placed = chosen.unionByName(others).select("key", "part", "tag", "id", "size").join(texts, "id").select("key", "part", "tag", "id", "size", "z", "f")
        placed = placed.repartition("key", "part").sortWithinPartitions("key", "part", "tag", "id")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            expand = zstandard.ZstdDecompressor().decompressobj

            def read(z: pa.Array, f: pa.Array, size: np.ndarray, begin: int, end: int) -> Iterator[Vector]:
                while begin < end:
                    upto = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:end]), 1 << 19, "right")))
                    own = np.concatenate([np.frombuffer(expand().decompress(f[i].as_py()), np.int32) for i in range(begin, upto)])
                    yield from vectors([expand().decompress(z[i].as_py()).decode() for i in range(begin, upto)], inverse_frequencies(documents, own))
                    begin = upto

            for run in groups(batches, 2):
                key, part = run.column(0)[0].as_py(), run.column(1)[0].as_py()
                tag, ids, size, z, f = (np.asarray(run.column(2)), np.asarray(run.column(3)), np.asarray(run.column(4)), run.column(5), run.column(6))
                n = int((tag == 0).sum())
                pivot_ids = ids[:n].tolist()
                own = list(read(z, f, size, 0, n))
                pivots = Pivots(own)
                root = list(range(n))

                def find(x: int) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                out: list[tuple] = []  # kind 0: link (a, b); 1: nearest unlinked member of pivot b, at distance d; 2: member a, nearest near pivot b
                for i in range(n) if not part else ():
                    like = pivots.similarity(own[i])
                    for j in np.flatnonzero(like[:i] >= LINKED).tolist():
                        a, b = find(i), find(j)
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            out.append((key, 0, pivot_ids[i], pivot_ids[j], 0, float(1 - like[j])))
                far = np.ones(n)
                for i, vector in enumerate(read(z, f, size, n, len(ids)), n):
                    like = pivots.similarity(vector)
                    near = like >= LINKED
                    far = np.where(near, far, np.minimum(far, 1 - like))
                    x, joined = int(ids[i]), {}
                    for j in sorted(np.flatnonzero(near).tolist(), key=lambda j: -like[j]):
                        joined.setdefault(find(j), j)
                    out += [(key, 0, x, pivot_ids[j], 0, float(1 - like[j])) for j in joined.values()]
                    if tag[i] == 1:
                        best = int(np.argmax(like))
                        out.append((key, 2, x, pivot_ids[best] if near[best] else None, int(size[i]), float(1 - like[best])))
                if n < len(ids):
                    out += [(key, 1, None, p, 0, f) for p, f in zip(pivot_ids, far.tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 5, pa.float64()), strict=True)], names=["key", "kind", "a", "b", "size", "d"])

        seen = materialise(placed.transform(map_batches, compare, "key long, kind long, a long, b long, size long, d double"), "links")
        linked = seen.where("kind = 0").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "d")
        found = linked if found is None else found.unionByName(linked)
        gap = seen.where("kind = 1").groupBy("key", "b").agg(F.min("d").alias("far"))
        bridge = F.col("far") - (1 - SIMILAR) - 1e-9
        left = seen.where("kind = 2").join(gap, ["key", "b"], "left").where(F.col("b").isNull() | (F.col("d") >= bridge)).select("key", F.col("a").alias("id"), "size")
        active = materialise(left, "active")
        if active.isEmpty():
            return found.groupBy("a", "b").agg(F.min("d").alias("d"))
        labelled = active.join(components(found), F.col("id") == F.col("node"), "left").select("key", "id", "size", F.coalesce("root", "id").alias("label"))
        labelled = materialise(labelled, "labelled")
        crowds = labelled.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
        most = F.max(F.struct("c", "label", "s")).alias("most")
        keys = crowds.groupBy("key").agg(F.sum("c").alias("n"), F.sum("s").alias("bytes"), F.count("*").alias("labels"), most).where("labels > 1")
        more = (F.col("n") - F.col("most.c") > PIVOTS) | (F.col("bytes") - F.col("most.s") > PIVOT_BYTES)
        apart = labelled.join(keys, "key").select("key", "id", "size", "n", (F.col("label") != F.col("most.label")).alias("apart"), more.alias("more"))
        order = Window.partitionBy("key").orderBy("id")
        first = apart.where("apart").withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS)
        first = first.withColumn("upto", F.sum("size").over(order)).where((F.col("k") == 1) | (F.col("upto") <= PIVOT_BYTES))
        chosen = first.select("key", "id", F.lit(True).alias("pivot"))
        state = materialise(apart.join(chosen, ["key", "id"], "left").select("key", "id", "size", "n", F.coalesce("pivot", F.lit(False)).alias("pivot"), "more"), "round")


LOWEST = -(1 << 63)


def text_key(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    """64 well-mixed bits of an id and a 16-byte hash."""
    h = np.frombuffer(b"".join(hashes.to_pylist()), np.uint64).reshape(-1, 2)[:, 0]
    return mix(np.asarray(ids).view(np.uint64) * STEP ^ h)


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, text_id, class_id, first, n_links, similarity) for each row.

    `text_id` is the least id of equal texts, `class_id` the least of the class: the texts that links
    of weighted similarity SIMILAR or more connect; without links a text and its copies. `first` marks
    one text of each class, that of the least id (null ids last, ties by hash), in its rows of that id.
    `n_links` counts the links found at the text, enough to connect its class though not all that
    exist, and `similarity` is the greatest of theirs, null without any. `text_hash` is the text's md5.

    Null texts are empty. Texts without a word are classed with equal texts only; very long texts are
    texts like others. Texts decide, not ids: different texts that share an id, or have none, are
    classed each by itself, and ids are null only where no row of the class has one. An empty table
    gives an empty one; other columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    blocks = materialise(in_blocks(docs.select("id", F.unhex(F.md5("t")).alias("h"), "t")), "blocks")
    documents, size = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    counted = document_frequencies(blocks, max(LEAST_PARTS, -(-size // PART_BYTES)))
    placed = blocks.select("block", F.lit(-1).cast("long").alias("part"), "z").unionByName(counted).repartition("block").sortWithinPartitions("block", "part")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for run in groups(batches, 1):
            batch = opened(run.column(2)[0].as_py())
            total = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(expand(x.as_py()), np.int32) for x in run.column(2)[1:])])
            slices = weighed_slices(batch.column(2))
            every = np.unique(np.concatenate([w[0] for w in slices]))
            keys, packed = [], []
            for found, of, times, n in slices:
                own = total[np.searchsorted(every, found)]
                keys += band_keys(found, of, times.astype(np.float32) * inverse_frequencies(documents, own), n)
                packed += [squeeze(x.tobytes()) for x in np.split(own, np.searchsorted(of, np.arange(1, n)))]
            length = pc.binary_length(batch.column(2)).cast(pa.int64())
            bands = pa.array([None if k is None else k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), length, bands, pa.array(packed, pa.binary())], names=["id", "h", "size", "bands", "f"])

    signed = materialise(placed.transform(map_batches, sign, "id long, h binary, size long, bands binary, f binary"), "signatures")
    release(blocks)
    firsts = [F.first(c).alias(c) for c in ("size", "bands", "f")]  # equal texts have equal ones
    distinct = signed.groupBy("h").agg(F.min("id").alias("id"), *firsts)
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")  # numbers hold once written

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(BANDS, dtype=np.uint64) * STEP)
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, BANDS) ^ salt
            where = pa.array(np.repeat(np.arange(len(keys)), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(0).take(where), batch.column(1).take(where)], names=["key", "id", "size"])

    banded = distinct.where("bands IS NOT NULL").select("node", "size", "bands").transform(map_batches, spread, "key long, id long, size long")
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.shiftright(F.xxhash64("id"), 24)).alias("s")).where("n > 1")
    once = shared.groupBy("n", "low", "x", "s").agg(F.min("key").alias("key")).select("key")  # keys with the same members count once
    active = materialise(banded.join(once, "key"), "candidates")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(text_key(batch.column(0), batch.column(1)).view(np.int64))], names=["key"])

    wanted = distinct.join(active.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", F.coalesce("id", F.lit(LOWEST)).alias("id"), "h", "f")
    wanted = materialise(wanted, "wanted")
    shared_filter = spark.sparkContext.broadcast(build(wanted.select("id", "h").transform(map_batches, keys, "key long")))  # 32 MB at most

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            own = batch.filter(pa.array(shared_filter.value.might_hold(text_key(batch.column(0), batch.column(2)))))
            rows = {k: i for i, k in enumerate(zip(own.column(0).to_pylist(), own.column(2).to_pylist(), strict=True))}
            own = own.take(pa.array(list(rows.values()), pa.int64()))  # repeated rows once
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array([pack(t.as_py().encode()) for t in own.column(1)], pa.binary())], names=["id", "h", "z"])

    texts = docs.select(F.coalesce("id", F.lit(LOWEST)).alias("id"), "t", F.unhex(F.md5("t")).alias("h")).transform(map_batches, squeeze, "id long, h binary, z binary")
    texts = texts.join(wanted, ["id", "h"])
    texts = materialise(texts.groupBy("node").agg(F.min(F.struct("z", "f")).alias("own")).select(F.col("node").alias("id"), "own.z", "own.f"), "texts")
    linked = materialise(links(active, texts, documents), "linked")
    release(texts, active, wanted)
    ends = linked.select(F.explode(F.array("a", "b")).alias("node"), "d").groupBy("node").agg(F.count("*").alias("n_links"), (1 - F.min("d")).alias("similarity"))
    named = distinct.select("h", "node", F.col("id").alias("text_id")).join(components(linked), "node", "left").join(ends, "node", "left")
    placed_first = F.struct(F.col("text_id").isNull().alias("null"), F.col("text_id").alias("id"), "h")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min(placed_first).alias("least"))
    named = named.join(least, "root", "left").withColumn("least", F.coalesce("least", placed_first))
    named = named.select("h", "text_id", F.col("least.id").alias("class_id"), (F.col("h") == F.col("least.h")).alias("leads"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "similarity")
    rows = signed.select(F.col("id").alias("doc_id"), "h").join(named, "h")
    first = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("text_id"))
    return rows.select("doc_id", F.col("h").alias("text_hash"), "text_id", "class_id", first.alias("first"), "n_links", "similarity")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` without those that another document stands for: of each class the first text stays.

    Of rows that repeat id and text the least by their other columns stays, which must have an order.
    See `classes` for nulls, ties and long texts; columns keep their names and order.

    Only rows that go or repeat have to be found by a join: a filter of bounded size lets most others
    pass where they are scanned, so their texts do not move. When it is full more of them take the join.
    """
    spark, names = df.sparkSession, df.columns
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST))
    found = classes(df, doc_id, text).groupBy(F.coalesce("doc_id", F.lit(LOWEST)).alias("__k"), F.col("text_hash").alias("__h")).agg(F.max("first").alias("__stays"), F.count("*").alias("__n"))
    touched = materialise(found.where("NOT __stays OR __n > 1"), "touched")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(text_key(batch.column(0), batch.column(1)).view(np.int64))], names=["key"])

    shared = spark.sparkContext.broadcast(build(touched.select("__k", "__h").transform(map_batches, keys, "key long")))  # 32 MB at most

    @F.arrow_udf("boolean")
    def might_go(k: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(shared.value.might_hold(text_key(k, h)))

    hashed = df.withColumns({"__k": key, "__h": F.unhex(F.md5(F.coalesce(text, F.lit(""))))})
    still = hashed.where(~might_go("__k", "__h")).select(*names)
    moved = hashed.where(might_go("__k", "__h")).join(touched, ["__k", "__h"], "left").where("coalesce(__stays, true)")
    others = [c for c in names if c != text]
    one = moved.groupBy("__k", "__h").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("__row"), F.min(F.col(f"`{text}`")).alias("__text"))
    return still.unionByName(one.select(*[F.col(f"__row.`{c}`") if c != text else F.col("__text").alias(text) for c in names]))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of `documents`: the least id of its text, the least id of its class, how many links were found at
    its text and the greatest similarity among them."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "text_id", "class_id", "n_links", "similarity")
