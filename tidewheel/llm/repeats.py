"""Exact removal of strings of SPAN bytes that start more than once in the corpus, by prefix-free parsing.

Texts are parsed at triggers of a rolling hash, chosen so that equal strings have equal triggers: the
trigger of a string of SPAN bytes is the leftmost least hash inside it. Every start position thus
belongs to one trigger, and a stretch of starts with one trigger is a phrase context: the bytes it
spans are an entry of the dictionary, and texts are sequences of entries (the parse).

Entries that occur again settle all their starts at once. For the others, two starts can only agree if
their contexts share the HALF bytes right of the trigger (the beginning of a parse suffix) or left of
it (a suffix of a dictionary entry). So only contexts that share such a half are compared, start by
start: their suffixes, cut at SPAN bytes, meet in groups of one half, where sorting them brings equal
ones side by side. Halves shared by very many contexts are compared through an aggregation instead.

Suffixes are ordered by two independent 64-bit fingerprints of all their SPAN bytes, and entries by two
of all of theirs, instead of letters: only equality counts. A text above LONG bytes is parsed in pieces
that hold all bytes of their starts; a context cut at a piece's end is one more entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidewheel.llm.arrow import map_batches
from tidewheel.llm.membership import build
from tidewheel.llm.near_duplicates import groups
from tidewheel.llm.texts import STEP, _power, buffers, byte_slices, mix
from tidewheel.sources.shared import materialise, release
from tidewheel.sources.tables import table

SPAN = 200
GRAM = 16
HALF = 100
CROWD = 2048
FLUSH = 1 << 18
LONG = 1 << 20
TOGETHER = 2048  # half contexts compared at once, some 600 kB

_U = np.uint64
_BASES = (0x100000001B3, 0x9E3779B97F4A7C15 | 1)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_TABLES = tuple(mix(np.arange(1, 257, dtype=_U) * STEP + _U(s)) for s in (12345, 987654321))
_NONE = _U(0)


class Prints:
    """Fingerprints of any stretch of a byte array, from running sums; two independent ones."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = []
        for t, b in zip(_TABLES, _BASES, strict=True):
            s = np.zeros(n + 1, _U)
            np.multiply(t[data], _power(b, n), out=s[1:])
            self.sums.append(np.cumsum(s, out=s))
        self.n = n

    def grams(self, which: int, width: int) -> np.ndarray:
        """`of` every start, all of one width, without look-ups."""
        s = self.sums[which]
        x = s[width:] - s[: self.n - width + 1]
        x *= _power(_INVERSES[which], self.n + 1)[: len(x)]
        x ^= _U(width)
        return mix(x)

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return mix((s[end] - s[start]) * _power(_INVERSES[which], self.n + 1)[start] ^ (end - start).astype(_U))


def parse(data: np.ndarray, at: np.ndarray, prints: Prints) -> dict[str, np.ndarray]:
    """Contexts of all texts: text number, first and last start (i0, i1) and trigger t, two prints u, v of their bytes and
    keys r, l of their halves (0: none)."""
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < SPAN:
        return dict.fromkeys("doc i0 i1 t".split(), empty) | dict.fromkeys("u v r l".split(), np.zeros(0, _U))
    at = at.astype(np.int64)
    least = prints.grams(0, GRAM)
    least &= _U(0xFFFFFFFF00000000)
    least |= np.arange(n - GRAM + 1, dtype=_U)
    width, span = 1, SPAN - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    trigger = (least & _U(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(trigger)]
    start = np.flatnonzero(np.arange(len(trigger)) + SPAN <= at[1:][doc])
    if not len(start):
        return parse(data[:0], at[:1], prints)
    trigger, doc = trigger[start], doc[start]
    first = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    i0, i1, t = start[first], start[last], trigger[first]
    u, v = (prints.of(which, i0, i1 + SPAN) for which in (0, 1))
    right, left = i1 >= t - HALF, i0 < t - HALF  # it has starts at most HALF before the trigger; further before
    r = np.where(right, prints.of(1, t, np.minimum(t + HALF, n)) | _U(1), _NONE)
    l = np.where(left, prints.of(1, np.maximum(t - HALF, 0), t) & ~_U(1) | _U(2), _NONE)
    return {"doc": doc[first], "i0": i0, "i1": i1, "t": t, "u": u, "v": v, "r": r, "l": l}


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def class_key(c: dict) -> np.ndarray:
    return mix(c["u"] ^ mix(c["v"] + STEP))


def parsed(column: pa.Array) -> Iterator[tuple[np.ndarray, Prints, dict]]:
    """Bytes, their prints and contexts, `doc` being the row and `base` what a place is counted from."""
    for begin, end in byte_slices(column):
        data, at = buffers(column.slice(begin, end - begin))
        if len(at) == 2 and len(data) > LONG:
            pieces = [(data[a : a + LONG + SPAN - 1], np.array([0, min(LONG + SPAN - 1, len(data) - a)]), a) for a in range(0, len(data) - SPAN + 1, LONG)]
        else:
            pieces = [(data, at, 0)]
        for own, ends, skipped in pieces:
            prints = Prints(own)
            c = parse(own, ends, prints)
            c["base"] = ends[c["doc"]] - skipped
            c["doc"] = c["doc"] + begin
            yield own, prints, c


def dictionary(texts: DataFrame) -> DataFrame:
    """(u, v, r, l, n, rows): entries of the corpus, occurrences, and tasks' flushes that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            x = np.concatenate(held, axis=1) if held else np.zeros((4, 0), _U)
            held, size = [], 0
            x = x[:, np.argsort(x[0])]
            first = np.flatnonzero(np.concatenate([[True] * min(1, x.shape[1]), (x[:, 1:] != x[:, :-1]).any(axis=0)]))
            n = np.diff(np.append(first, x.shape[1]))
            return pa.RecordBatch.from_arrays([*[signed(row[first]) for row in x], pa.array(n, pa.int64())], names=["u", "v", "r", "l", "n"])

        for batch in batches:
            for _, _, c in parsed(batch.column(0)):
                held.append(np.stack([c["u"], c["v"], c["r"], c["l"]]))
                size += len(c["u"])
                if size >= FLUSH:
                    yield flush()
        yield flush()

    return texts.transform(map_batches, run, "u long, v long, r long, l long, n long").groupBy("u", "v", "r", "l").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))


def repeated_starts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h, a, b): in the document of key (k, h), every string of SPAN bytes that starts at a to b starts elsewhere too."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.coalesce(text, F.lit("")).alias("t"))
    entries = dictionary(docs.select("t"))
    again = entries.where("n > 1").select(F.lit(0).alias("kind"), "u", "v")
    sides = entries.select(F.explode(F.array("r", "l")).alias("u"), "rows").where("u <> 0")
    halves = sides.groupBy("u").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).where("n > 1")
    halves = halves.select(F.when(F.col("rows") > CROWD, F.lit(2)).otherwise(F.lit(1)).alias("kind"), "u", F.lit(0).cast("long").alias("v"))
    known = materialise(again.unionByName(halves), "known")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: np.asarray(batch.column(i)).view(_U) for i, n in enumerate("uv")}
            yield pa.RecordBatch.from_arrays([signed(class_key(c))], names=["key"])

    filters = spark.sparkContext.broadcast([build(known.where("kind = 0").select("u", "v").transform(map_batches, key, "key long")), build(known.where("kind > 0").select("u")), build(known.where("kind = 2").select("u"))])

    names = ["kind", "u", "v", "k", "h", "i0", "i1", "bytes"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: contexts whose entry may occur again; 1: bytes of half contexts to compare; 2: starts of crowded halves."""
        classes, halves, crowded = filters.value
        for batch in batches:
            k, h = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for data, prints, c in parsed(batch.column(2)):
                if not len(c["u"]):
                    continue
                doc, base = c["doc"], c["base"]
                repeats = classes.might_hold(class_key(c))
                rows = np.flatnonzero(repeats)
                none = pa.nulls(len(rows), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int64)), signed(c["u"][rows]), signed(c["v"][rows]), pa.array(k[doc[rows]]), pa.array(h[doc[rows]]), pa.array((c["i0"] - base)[rows]), pa.array((c["i1"] - base)[rows]), none], names=names)
                once = np.ones(len(repeats), bool)  # of an entry that may occur again one context is evidence enough
                _, kept = np.unique(c["u"][repeats], return_index=True)
                once[rows] = False
                once[rows[kept]] = True
                for side, lo, hi in (("r", np.maximum(c["i0"], c["t"] - HALF), c["i1"]), ("l", c["i0"], np.minimum(c["i1"], c["t"] - HALF - 1))):
                    rows = np.flatnonzero(once & (c[side] != 0))
                    rows = rows[halves.might_hold(c[side][rows])]
                    many = crowded.might_hold(c[side][rows])
                    some = rows[~many]
                    if len(some):
                        pieces = [data[a : b + SPAN].tobytes() for a, b in zip(lo[some], hi[some], strict=True)]
                        zero = signed(np.zeros(len(some), _U))
                        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int64)), signed(c[side][some]), zero, pa.array(k[doc[some]]), pa.array(h[doc[some]]), pa.array((lo - base)[some]), pa.array((hi - base)[some]), pa.array(pieces, pa.binary())], names=names)
                    rows = rows[many]
                    if len(rows):
                        n = hi[rows] - lo[rows] + 1
                        of = np.repeat(rows, n)
                        start = np.repeat(lo[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        a, b = prints.of(0, start, start + SPAN), prints.of(1, start, start + SPAN)
                        place = pa.array(start - base[of])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), 2)), signed(a), signed(b), pa.array(k[doc[of]]), pa.array(h[doc[of]]), place, place, pa.nulls(len(of), pa.binary())], names=names)

    found = materialise(docs.transform(map_batches, look_up, "kind long, u long, v long, k long, h long, i0 long, i1 long, bytes binary"), "contexts")
    whole = found.where("kind = 0").join(known.where("kind = 0").select("u", "v"), ["u", "v"], "left_semi").select("k", "h", F.col("i0").alias("a"), F.col("i1").alias("b"))
    starts = found.where("kind = 2").select("u", "v", "k", "h", "i0")
    common = starts.groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1").select("u", "v")
    single = starts.join(common, ["u", "v"], "left_semi").select("k", "h", F.col("i0").alias("a"), F.col("i0").alias("b"))
    halves = found.where("kind = 1").select("u", "k", "h", "i0", "bytes").repartition("u").sortWithinPartitions("u")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorts the cut suffixes of whole groups, many groups at once, and returns runs of starts that are not alone."""
        held: list[pa.RecordBatch] = []
        rows = 0

        def settle() -> pa.RecordBatch:
            nonlocal held, rows
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
            pieces = block.column(4).cast(pa.large_binary())
            at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
            prints = Prints(np.frombuffer(pieces.buffers()[2], np.uint8)[at[0] : at[-1]])
            at = at - at[0]
            n = np.diff(at) - SPAN + 1
            of = np.repeat(np.arange(len(n)), n)
            local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = at[of] + local
            a, b = prints.of(0, start, start + SPAN), prints.of(1, start, start + SPAN)
            order = np.lexsort((b, a))
            same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            alike = np.zeros(len(order), bool)
            alike[order[1:][same]] = alike[order[:-1][same]] = True
            edge = np.concatenate([[True], of[1:] != of[:-1]])
            opens = np.flatnonzero(alike & (edge | np.concatenate([[True], ~alike[:-1]])))
            closes = np.flatnonzero(alike & (np.append(edge[1:], True) | np.append(~alike[1:], True)))
            row = of[opens]
            base = np.asarray(block.column(3))[row]
            where = pa.array(row)
            return pa.RecordBatch.from_arrays([block.column(1).take(where), block.column(2).take(where), pa.array(base + local[opens]), pa.array(base + local[closes])], names=["k", "h", "a", "b"])

        for run in groups(batches, 1):
            if run.num_rows > 1:
                held.append(run)
                rows += run.num_rows
                if rows >= TOGETHER:
                    yield settle()
        if held:
            yield settle()

    part = halves.transform(map_batches, compare, "k long, h long, a long, b long")
    every = materialise(whole.unionByName(single).unionByName(part), "starts")
    release(found, known)
    return every


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row, with keep_text also the kept text, then the carried columns.

    Every byte that a repeated string of SPAN bytes covers goes, in all its occurrences; matches stay
    within a row, and repeated rows are occurrences of their own. Null texts are empty, texts below
    SPAN bytes lose nothing, very long ones are parsed in pieces, null ids stay. Kept text leaves out
    bytes of characters that were cut.
    An empty table gives an empty one; other columns are ignored.
    """
    spark = df.sparkSession
    starts = repeated_starts(df, doc_id, text)
    lowest = -(1 << 63)

    def doc_key(batch: pa.RecordBatch) -> np.ndarray:
        k, h = (np.asarray(batch.column(i)).view(_U) for i in (0, 1))
        return mix(k * STEP ^ mix(h))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([signed(doc_key(batch))], names=["key"])

    shared = spark.sparkContext.broadcast(build(starts.select("k", "h").distinct().transform(map_batches, keys, "key long")))
    carried = df.select(*[F.col(f"`{c}`") for c in carry or []]).schema.fields
    docs = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(lowest)).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.coalesce(text, F.lit("")).alias("t"), *[F.col(f"`{f.name}`").alias(f"__{f.name}") for f in carried])
    made = [StructField(c, LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [StructField(c, StringType()) for c in ["kept_sha256", "text"][: 1 + keep_text]]
    extra = [StructField(f"__{f.name}", f.dataType) for f in carried]
    names, types = [f.name for f in made], [pa.string() if f.dataType == StringType() else pa.int64() for f in made]

    def row(k: int, data: bytes, spans: list[tuple[int, int]]) -> tuple:
        pieces, at = [], 0
        for a, b in spans:
            pieces.append(data[at:a])
            at = b
        kept = b"".join([*pieces, data[at:]])
        out = (None if k == lowest else k, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        return (*out, kept.decode("utf-8", "ignore")) if keep_text else out

    def columns(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that nothing can touch."""
        for batch in batches:
            own = batch.filter(pa.array(~shared.value.might_hold(doc_key(batch))))
            rows = [row(k, t.as_py().encode(), []) for k, t in zip(own.column(0).to_pylist(), own.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns(rows), *own.columns[3:]], names=names + own.schema.names[3:])

    def moving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other texts, compressed for the way."""
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            own = batch.filter(pa.array(shared.value.might_hold(doc_key(batch))))
            z = pa.array([pack(t.as_py().encode()) for t in own.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([*own.columns[:2], z, *own.columns[3:]], names=["k", "h", "z", *own.schema.names[3:]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompressobj
        at, spans = None, []
        for batch in batches:
            rows, of = [], []
            for i, (k, h, tag, a, b) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:5]], strict=True)):
                if (k, h) != at:
                    at, spans = (k, h), []
                if tag:
                    rows.append(row(k, expand().decompress(batch.column(5)[i].as_py()), spans))
                    of.append(i)
                elif spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], b + SPAN))
                else:
                    spans.append((a, b + SPAN))
            yield pa.RecordBatch.from_arrays([*columns(rows), *batch.take(pa.array(of, pa.int64())).columns[6:]], names=names + batch.schema.names[6:])

    out = StructType(made + extra)
    still = docs.transform(map_batches, whole, out)
    texts = docs.transform(map_batches, moving, StructType([StructField("k", LongType()), StructField("h", LongType()), StructField("z", BinaryType()), *extra]))
    zero = F.lit(0).cast("long")
    texts = texts.select("k", "h", F.lit(1).cast("long").alias("tag"), zero.alias("a"), zero.alias("b"), "z", *[f.name for f in extra])
    runs = starts.select("k", "h", zero.alias("tag"), "a", "b", F.lit(None).cast("binary").alias("z"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    met = texts.unionByName(runs).repartition("k", "h").sortWithinPartitions("k", "h", "tag", "a")
    done = still.unionByName(met.transform(map_batches, cut, out))
    return done.toDF(*names, *[f.name for f in carried])


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of `documents`: its bytes, how many go, in how many runs, and the sha256 of what stays."""
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every string of SPAN bytes by itself; runs of starts at most SPAN apart are removed together.
OP3_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS MATERIALIZED (SELECT k, i, array_slice(b, i + 1, i + 200) AS w FROM (SELECT k, b, unnest(range(octet_length(b) - 199)) AS i FROM d)),
g AS (SELECT k, i FROM s WHERE w IN (SELECT w FROM s GROUP BY w HAVING count(*) > 1)),
m AS (SELECT k, i, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM g)),
r AS (SELECT k, min(i) AS a, max(i) + 200 AS z FROM m GROUP BY k, run),
p AS (SELECT k, lag(z, 1, 0) OVER (PARTITION BY k ORDER BY a) AS f, a AS t, z - a AS cut FROM r
      UNION ALL SELECT k, coalesce(max(z), 0), max(octet_length(b)), 0 FROM d LEFT JOIN r USING (k) GROUP BY k)
SELECT any_value(doc_id) AS doc_id, any_value(octet_length(b)) AS n_bytes, sum(cut)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
       sha256(unhex(string_agg(CASE WHEN f < t THEN hex(array_slice(b, f + 1, t)) ELSE '' END, '' ORDER BY f))) AS kept_sha256
FROM p JOIN d USING (k) GROUP BY k
"""
