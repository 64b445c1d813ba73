"""Document fingerprints: threshold-scaled sketches of byte shingles.

A sketch keeps the hash of every run of WIDTH bytes that falls below one FRACTIONth of the hash range,
the same for every text, so the sketch of a union is the union of the sketches, and containment
between very unequal texts follows from the sketches alone. A text shorter than WIDTH is one shingle.
A text none of whose hashes is that low carries a digest of its shingles instead, which is alike to an
equal digest only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidewheel.llm.arrow import map_batches
from tidewheel.llm.texts import STEP, _power, mix
from tidewheel.sources.tables import table

WIDTH = 24
FRACTION = 16  # one in so many
LIMIT = np.uint64((1 << 64) // FRACTION)
AT_ONCE = 1 << 19  # bytes hashed at a time, so memory does not grow with a text
RANGE_BYTES = 64 << 20  # of text in one range of ids

_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * STEP + np.uint64(77))

#: Sorted hashes below LIMIT, and a digest of all shingles if there are none.
Sketch = tuple[np.ndarray, bytes]


def shingle_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each run of WIDTH bytes; of the whole, if it is shorter; none of nothing."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, WIDTH)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _power(_BASE, n))])
    return mix((sums[width:] - sums[:-width]) * _power(_INVERSE, n)[: n - width + 1] + np.uint64(width))


def sketch(text: str) -> Sketch:
    data = np.frombuffer(text.encode(), np.uint8)
    low, least = [], []
    for at in range(0, max(1, len(data) - WIDTH + 1), AT_ONCE):
        found = shingle_hashes(data[at : at + AT_ONCE + WIDTH - 1])
        low.append(found[found < LIMIT])
        if not len(low[0]):
            least.append(np.unique(found))
    kept = np.unique(np.concatenate(low))
    return kept, b"" if len(kept) else hashlib.md5(np.unique(np.concatenate(least)).tobytes()).digest()


def common(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    """Hashes of a, of b and of both."""
    return len(a[0]), len(b[0]), len(np.intersect1d(a[0], b[0], assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity; of two sketches without a hash, 1 if their shingles are equal, else 0."""
    x, y, both = common(a, b)
    return both / (x + y - both) if x + y else float(a[1] == b[1])


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has; without a hash of a, whether the digests are equal."""
    x, _, both = common(a, b)
    return both / x if x else float(a[1] == b[1])


def merge(a: Sketch, b: Sketch) -> Sketch:
    """Sketch of both texts' shingles together. Two that have no hash and are unlike give a digest of their own."""
    kept = np.union1d(a[0], b[0])
    if len(kept) or a[1] == b[1]:
        return kept, b"" if len(kept) else a[1]
    return kept, hashlib.md5(min(a[1], b[1]) + max(a[1], b[1])).digest()


def encode(own: Sketch) -> str:
    """As text: the fraction, the hashes in ascending order, the digest if there is none."""
    return f"1/{FRACTION}:{base64.b64encode(own[0].astype('<u8').tobytes()).decode()}:{own[1].hex()}"


def decode(text: str) -> Sketch:
    _, hashes, digest = text.split(":")
    return np.frombuffer(base64.b64decode(hashes), "<u8"), bytes.fromhex(digest)


LOWEST = -(1 << 63)
SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()),
    StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()),
])


class Ranges:
    """Ranges of (p, tie), in order of p. `cuts` may repeat a value: a place that holds that many ranges' worth of rows is divided by tie."""

    def __init__(self, cuts: list[int]):
        values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.values, self.parts = values, np.where(times > 1, times, 0)
        self.first = np.cumsum(self.parts + 1) - self.parts  # number of the first range of a value

    def __len__(self) -> int:
        return int(1 + (self.parts + 1).sum())

    def of(self, p: np.ndarray, tie: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(p), np.int64)
        at = np.searchsorted(self.values, p, "right") - 1  # last value that is not above p
        some = np.maximum(at, 0)
        parts, first = self.parts[some], self.first[some]
        upper = (tie.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # ascending with the signed tie
        divided = first + (upper * parts.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        return np.where(at < 0, 0, np.where((parts > 0) & (p == self.values[some]), divided, first + parts))


def fingerprint_with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = 1 << 21, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited form, which borrows from the next document.

    The last floor(n_chars / 2) code points are replaced by the first as many of the next document by
    descending id; after the last comes the first. Null ids come last. Rows that share an id follow by
    hash of their text; repeated rows are documents of their own. Null texts are empty. Very long texts
    are hashed piece by piece. An empty table gives an empty one; other columns are ignored.

    Documents move once: compressed, to the range of ids that holds them, sorted there, read as a
    stream. Ranges are cut at quantiles of the ids, one for each RANGE_BYTES of text or, if more, each
    shuffle partition; an id that fills several is divided by hash of the text. Equal rows of a batch
    move as one with a count. The first document of each range moves to the range before as well, as
    the one that follows its last.
    """
    spark = df.sparkSession
    ids = df.select(F.bitwise_not(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST))).alias("p"), F.coalesce(text, F.lit("")).alias("t"))
    size = ids.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    found = ids.agg(F.percentile_approx("p", [i / n for i in range(1, n)], 4 * n)).first()[0] if n > 1 else []
    cut = Ranges(found or [])
    keyed = ids.select("p", F.xxhash64("t").alias("tie"))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, int]] = {}
        for batch in batches:
            p, tie = (np.asarray(batch.column(i)) for i in (0, 1))
            b = cut.of(p, tie)
            order = np.lexsort((tie, p, b))
            for i in order[np.concatenate([[True], b[order][1:] != b[order][:-1]])] if len(order) else ():
                own = (int(p[i]), int(tie[i]))
                least[int(b[i])] = min(least.get(int(b[i]), own), own)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*[(b, *x) for b, x in least.items()], strict=True) if least else [()] * 3)], names=["b", "p", "tie"])

    # one row for each range
    heads = {r["b"]: tuple(r["first"]) for r in keyed.transform(map_batches, firsts, "b long, p long, tie long").groupBy("b").agg(F.min(F.struct("p", "tie")).alias("first")).collect()}
    order = sorted(heads)
    tail_of = {heads[b]: order[i - 1] for i, b in enumerate(order)}  # a range's first follows the last of the range before
    starts = np.array(sorted(p for p, _ in tail_of), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            p, tie = (np.asarray(batch.column(i)) for i in (0, 2))
            rows: dict[tuple, int] = {}
            for key in zip(p.tolist(), tie.tolist(), batch.column(1).to_pylist(), strict=True):
                rows[key] = rows.get(key, 0) + 1
            p, tie = (np.array([k[i] for k in rows], np.int64) for i in (0, 1))
            z, counts, where = [squeeze(k[2].encode()) for k in rows], list(rows.values()), cut.of(p, tie)
            extra = [i for i in np.flatnonzero(np.isin(p, starts)).tolist() if (int(p[i]), int(tie[i])) in tail_of]
            every = [*range(len(p)), *extra]
            columns = [
                pa.array([*where.tolist(), *[tail_of[int(p[i]), int(tie[i])] for i in extra]], pa.int64()), pa.array([0] * len(p) + [1] * len(extra), pa.int32()),
                pa.array(p[every]), pa.array(tie[every]), pa.array([counts[i] for i in every], pa.int64()), pa.array([z[i] for i in every], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["b", "tail", "p", "tie", "n", "z"])

    dealt = ids.select("p", "t", F.xxhash64("t").alias("tie")).transform(map_batches, deal, "b long, tail int, p long, tie long, n long, z binary")
    placed = dealt.repartitionById(len(cut), F.col("b").cast("int")).sortWithinPartitions("b", "tail", "p", "tie", "z")

    def rows_of(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2), strict=True)], names=SCHEMA.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompressobj
        before: tuple | None = None  # (p, text, sketch, encoded) of the document whose next is awaited
        made, held, at, closed = [], 0, None, False

        def row(a: tuple, b: tuple) -> tuple:
            """Of a document that b follows."""
            half = len(a[1]) // 2
            edited = a[1][: len(a[1]) - half] + b[1][:half]
            changed = sketch(edited)
            return (None if a[0] == ~LOWEST else ~a[0], len(a[1]), hashlib.sha256(edited.encode()).hexdigest(), a[3], encode(changed), likeness(a[2], changed), likeness(a[2], b[2]))

        for batch in batches:
            for b, tail, p, n, z in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], batch.column(5), strict=True):
                if b != at:
                    at, closed, before = b, False, None
                if closed:  # further rows equal to the first of the next range
                    continue
                t = expand().decompress(z.as_py()).decode()
                own = (p, t, (s := sketch(t)), encode(s))
                if before is not None:
                    made.append(row(before, own))
                    held += 2 * len(made[-1][3])
                before, closed = own, bool(tail)
                copies = row(own, own) if n > 1 and not tail else None
                for _ in range(n - 1 if copies else 0):
                    made.append(copies)
                    held += 2 * len(copies[3])
                    if held > block:
                        yield rows_of(made)
                        made, held = [], 0
                if held > block:
                    yield rows_of(made)
                    made, held = [], 0
        if made:
            yield rows_of(made)

    return placed.transform(map_batches, run, SCHEMA)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of `documents`: n_chars, sha256 of its edited text, fingerprints of both, and how like its
    fingerprint is to the edited text's and to the next document's (by descending id, after the last the first)."""
    return fingerprint_with_next(table(spark, sf_dir, "documents"))


def _whole(x: int) -> str:
    return f"{x}::UHUGEINT"


def _mixed(x: str) -> str:
    """`mix` of a 64-bit value that SQL holds in 128 bits."""
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = f"(xor({x}, {x} >> {by}) * {_whole(factor)} & {_whole((1 << 64) - 1)})"
    return f"xor({x}, {x} >> 31)"


#: Ids must be unique: SQL has no hash of ours to order texts of one id by. Powers double their list each round; a shingle
#: is the sum of its letters' terms, carried back to the power 0.
OP8_SQL = """
WITH RECURSIVE powers AS (
  SELECT [1]::UHUGEINT[] AS up, [1]::UHUGEINT[] AS down, {base}::UHUGEINT AS u, {inverse}::UHUGEINT AS d
  UNION ALL
  SELECT list_concat(up, list_transform(up, lambda x: x * u & {mask})), list_concat(down, list_transform(down, lambda x: x * d & {mask})), u * u & {mask}, d * d & {mask}
  FROM powers WHERE len(up) < 2 + 2 * (SELECT max(octet_length(encode(text))) FROM documents)),
longest AS (SELECT up, down FROM powers ORDER BY len(up) DESC LIMIT 1),
power AS (SELECT unnest(up) AS up, unnest(down) AS down, unnest(range(len(up))) AS i FROM longest),
letter AS (SELECT unhex(printf('%02x', c)) AS c, {mix_letter} AS v FROM (SELECT c::INTEGER AS c, ((c + 1)::UHUGEINT * {step} + 77) & {mask} AS x FROM range(256) AS t(c))),
docs AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS k, count(*) OVER () AS n, doc_id, coalesce(text, '') AS own FROM documents),
pair AS (SELECT a.k, b.k AS next, a.doc_id, length(a.own) AS n_chars, a.own, left(a.own, length(a.own) - length(a.own) // 2) || left(b.own, length(a.own) // 2) AS edited
         FROM docs a JOIN docs b ON b.k = a.k % a.n + 1),
texts AS (SELECT 2 * k AS t, encode(own) AS b FROM pair UNION ALL SELECT 2 * k + 1, encode(edited) FROM pair),
bytes AS (SELECT t, i, octet_length(b) AS n, array_slice(b, i + 1, i + 1) AS c FROM (SELECT t, b, unnest(range(octet_length(b))) AS i FROM texts)),
terms AS (SELECT t, i, n, (v * up & {mask})::HUGEINT AS term, down FROM bytes JOIN letter USING (c) JOIN power USING (i)),
sums AS (SELECT t, i, n, down, sum(term) OVER (PARTITION BY t ORDER BY i ROWS BETWEEN CURRENT ROW AND {width} - 1 FOLLOWING) AS s FROM terms),
raw AS (SELECT t, ((s::UHUGEINT & {mask}) * down + least(n, {width})::UHUGEINT) & {mask} AS x FROM sums WHERE i <= greatest(n - {width}, 0)),
hashes AS MATERIALIZED (SELECT DISTINCT t, {mix_hash} AS x FROM raw),
written AS (SELECT t, x, x < {limit} AS low, lpad(hex(x::UBIGINT), 16, '0') AS h FROM hashes),
turned AS (SELECT t, x, low, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS h FROM written),
sketch AS (SELECT t, count(*) FILTER (low) AS n, coalesce(string_agg(h, '' ORDER BY x) FILTER (low), '') AS kept, coalesce(string_agg(h, '' ORDER BY x), '') AS every FROM texts LEFT JOIN turned USING (t) GROUP BY t),
print AS (SELECT t, n, '1/{fraction}:' || to_base64(unhex(kept)) || ':' || CASE WHEN n = 0 THEN md5(unhex(every)) ELSE '' END AS f FROM sketch),
met AS (SELECT a.t, b.t AS other, count(*) AS both FROM hashes a JOIN hashes b USING (x) WHERE a.x < {limit} AND a.t % 2 = 0 AND
        (b.t = a.t + 1 OR b.t = (a.t // 2) % (SELECT count(*) FROM documents) * 2 + 2) GROUP BY 1, 2),
near AS (SELECT p.k, p.doc_id, p.n_chars, sha256(p.edited) AS edited_sha256, a.f AS fingerprint, e.f AS edited_fingerprint,
         CASE WHEN a.n + e.n = 0 THEN (a.f = e.f)::DOUBLE ELSE coalesce(x.both, 0)::DOUBLE / (a.n + e.n - coalesce(x.both, 0)) END AS near_edited,
         CASE WHEN a.n + b.n = 0 THEN (a.f = b.f)::DOUBLE ELSE coalesce(y.both, 0)::DOUBLE / (a.n + b.n - coalesce(y.both, 0)) END AS near_next
         FROM pair p JOIN print a ON a.t = 2 * p.k JOIN print e ON e.t = 2 * p.k + 1 JOIN print b ON b.t = 2 * p.next
         LEFT JOIN met x ON x.t = a.t AND x.other = e.t LEFT JOIN met y ON y.t = a.t AND y.other = b.t)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next FROM near
""".format(base=_BASE, inverse=_INVERSE, mask=_whole((1 << 64) - 1), step=_whole(int(STEP)), width=WIDTH, limit=_whole(int(LIMIT)), fraction=FRACTION, mix_letter=_mixed("x"), mix_hash=_mixed("x"))
