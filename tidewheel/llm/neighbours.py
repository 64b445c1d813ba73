"""Approximate nearest neighbours by multiprobe p-stable hashing.

Distinct unit vectors are projected onto Gaussian directions and cut into cells, `tables` times, with
more directions for more vectors. A query visits its own cell of each table and perturbed ones, in
order of the squared distances from its projections to the crossed cell walls, summed. It first visits
a few. The k-th cosine found there says where a neighbour that is still missing could be: its
projections are normal around the query's, so each cell has a known chance to hold it, and the query
goes on until the cells visited add up to the chance `success`. Queries with near neighbours stop
early; one that has found fewer than k meets all vectors, in blocks.

Vectors and probes of a cell meet in one sorted run of rows; cells with many of either are split into
chunks that meet pairwise, so no run is longer than a chunk of each. Exact cosines, in double
precision, rank what the cells hold, then what all tables found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.arrow import map_batches
from tidewheel.llm.texts import mix
from tidewheel.sources.shared import materialise
from tidewheel.sources.tables import table


_erf = np.frompyfunc(math.erf, 1, 1)


def below(z: np.ndarray) -> np.ndarray:
    """Distribution function of the standard normal."""
    return 0.5 + 0.5 * _erf(z * 0.5**0.5).astype(float)


@dataclass(frozen=True)
class Hashing:
    tables: int = 4
    hashes: int = 7
    width: float = 2.0
    first: int = 24
    success: float = 0.96
    seed: int = 11

    @staticmethod
    def of_size(n: int) -> Hashing:
        """A direction more for each sixfold number of vectors from 60,000 on, up to 10, so that cells don't fill up."""
        return Hashing(hashes=7 + min(3, max(0, int(math.log(max(1, n / 10_000), 6)))))

    def directions(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, size])
        return rng.normal(size=(size, self.tables * self.hashes)), rng.uniform(0, self.width, self.tables * self.hashes)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell coordinates and place within the cell, [row, table, hash], of unit vectors."""
        a, b = self.directions(x.shape[1])
        at = ((x @ a + b) / self.width).reshape(len(x), self.tables, self.hashes)
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def keys(self, cell: np.ndarray, size: int) -> np.ndarray:
        """One 64-bit key for each [..., table, hash] cell; equal keys of different cells only add candidates."""
        key = np.full(cell.shape[:-1], size, np.uint64)
        key += np.arange(self.tables, dtype=np.uint64).reshape(*[1] * (cell.ndim - 2), -1) << np.uint64(32)
        for i in range(self.hashes):
            key = mix(key ^ cell[..., i].astype(np.uint64))
        return key.view(np.int64)

    def chances(self, x: np.ndarray, cosine: float) -> np.ndarray:
        """[table, hash, step + 1]: chance that a vector at that cosine of the unit vector x is a step from its cell."""
        a, b = self.directions(len(x))
        at = (x @ a).reshape(self.tables, self.hashes)
        low = np.floor((at + b.reshape(at.shape)) / self.width) * self.width - b.reshape(at.shape)
        walls = low[..., None] + self.width * np.arange(-1, 3)
        return np.diff(below((walls - cosine * at[..., None]) / math.sqrt(1 - cosine**2)), axis=-1)

    def probes(self, x: np.ndarray, cosine: float | None) -> list[np.ndarray]:
        """For each table [probe, hash]: cells of a unit vector to visit, nearest walls first.

        Without a cosine the first ones; with that of the k-th vector found, those from there on that
        the wanted success takes.
        """
        steps = _steps(self.hashes)
        cell, within = (y[0] for y in self.cells(x[None]))
        wall = np.stack([within**2, np.zeros_like(within), (1 - within) ** 2], axis=-1)  # for steps -1, 0, 1
        order = np.argsort(sum(wall[:, h][:, steps[:, h] + 1] for h in range(self.hashes)), axis=1, kind="stable")
        upto = np.full(self.tables, self.first)
        if cosine is not None:
            chance = self.chances(x, min(max(cosine, 0.0), 0.9999))
            of = np.ones((self.tables, len(steps)))
            for h in range(self.hashes):
                of *= chance[:, h][:, steps[:, h] + 1]
            wanted = 1 - (1 - self.success) ** (1 / self.tables)
            upto = np.array([np.searchsorted(np.cumsum(of[t][order[t]]), wanted) + 1 for t in range(self.tables)])
        begin = 0 if cosine is None else self.first
        return [cell[t] + steps[order[t, begin : upto[t]]] for t in range(self.tables)]


@lru_cache(maxsize=4)
def _steps(hashes: int) -> np.ndarray:
    return np.array(list(product((-1, 0, 1), repeat=hashes)), np.int64)


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors of each length in a list column."""
    values = batch.column(column)
    sizes = np.diff(np.asarray(values.offsets))
    flat = np.asarray(values.flatten(), dtype=np.float64)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[(ends[rows] - size)[:, None] + np.arange(size)]


def search(df: DataFrame, is_query: Column, k: int = 5, hashing: Hashing | None = None, chunk: int = 4096, query_chunk: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine that were found for each query row.

    A query's own id is no candidate. Ties go to the smaller id; rows that repeat id and vector count
    once. Null ids and unusable vectors take no part, and vectors of another length are never
    candidates. A query without any candidate has no row; one with fewer than k has them all. An empty
    table gives an empty one, other columns are ignored. `hashing` follows the number of vectors,
    unless it is given.

    Equal vectors are one class in the index: only the k + 1 smallest ids of a class can be among the
    nearest k of anything, so they are all that is kept of it.
    """
    rows = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).groupBy(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).agg(F.max(is_query).alias("asks"))
    rows = materialise(rows, "vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    members = materialise(members.withColumn("class", F.min("vec_id").over(Window.partitionBy("v"))).drop("asks"), "classes")
    classes = members.where("n = 1").select("class", "v")
    asking = materialise(rows.where("asks").groupBy("v").agg(F.count("*").alias("m")).select("v").join(classes, "v").select("class", "v"), "asking")
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").join(classes, "v").select("query_id", F.col("class").alias("q"))
    n = classes.count()
    own = hashing or Hashing.of_size(n)
    listed = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch, 1):
                cell, _ = own.cells(x / np.linalg.norm(x, axis=1, keepdims=True))
                key = own.keys(cell[:, None], x.shape[1]).reshape(len(rows), -1)
                where = pa.array(np.repeat(rows, key.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column(0).take(where), batch.column(1).take(where)], names=["key", "c", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(class, v) or (class, v, cosine of the k-th found)."""
        for batch in batches:
            cosines = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for rows, x in matrices(batch, 1):
                for at, vector in zip(rows.tolist(), x / np.linalg.norm(x, axis=1, keepdims=True), strict=True):
                    cells = own.probes(vector, cosines[at])
                    blank = np.zeros((max(map(len, cells)), own.tables, own.hashes), np.int64)
                    for t, c in enumerate(cells):
                        blank[: len(c), t] = c
                    key = own.keys(blank, x.shape[1])
                    key = np.concatenate([key[: len(c), t] for t, c in enumerate(cells)])
                    where = pa.array(np.full(len(key), at))
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(where), batch.column(1).take(where)], names=["key", "c", "v"])

    schema = f"key long, c long, v {listed}"
    indexed = classes.transform(map_batches, index, schema)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[list[np.ndarray]] = [[], [], []]

        def meet(run: pa.RecordBatch) -> None:
            tag = np.asarray(run.column(3))
            split = int(np.searchsorted(tag, 1))
            if not 0 < split < len(tag):
                return
            c = np.asarray(run.column(4))
            known, asked = ({x.shape[1]: (c[s.start + rows], x) for rows, x in matrices(run.slice(s.start, s.stop - s.start), 5)} for s in (slice(0, split), slice(split, len(tag))))
            for size in known.keys() & asked.keys():
                (xc, x), (qc, q) = known[size], asked[size]
                score = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
                best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                found[0].append(np.repeat(qc, best.shape[1]))
                found[1].append(xc[best].ravel())
                found[2].append(np.take_along_axis(score, best, 1).ravel())

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["q", "c", "score"])
            for x in found:
                x.clear()
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(i)) for i in range(3)])
            starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(starts, starts[1:], strict=False):
                if a == 0 and held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(3)):
                    meet(pa.concat_batches(held))
                    held = []
                if a:
                    meet(pa.concat_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
            yield out()
        if held:
            meet(pa.concat_batches(held))
        yield out()

    def best_of(df: DataFrame) -> DataFrame:
        merged = df.groupBy("q", "c").agg(F.max("score").alias("score"))
        return merged.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("n") <= k + 1).drop("n")

    def met_in(known: DataFrame, probing: DataFrame) -> DataFrame:
        """(q, c, score): the best that each query finds in the cells it shares with vectors."""

        def crowded(side: DataFrame, limit: int, name: str) -> DataFrame:
            return side.groupBy("key").agg(F.ceil(F.count("*") / limit).alias(name)).where(F.col(name) > 1)

        parts = crowded(known, chunk, "xs").join(crowded(probing, query_chunk, "qs"), "key", "full")

        def chunked(side: DataFrame, here: str, other: str, tag: int) -> DataFrame:
            """Each row in one chunk of its own side and in all of the other side's."""
            df = side.join(parts, "key", "left").fillna(1, ["xs", "qs"])
            df = df.withColumn(here[0] + "c", F.pmod(F.xxhash64("c"), F.col(here)))
            return df.withColumn(other[0] + "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("key", "xc", "qc", F.lit(tag).alias("tag"), "c", "v")

        met = chunked(known, "xs", "qs", 0).unionByName(chunked(probing, "qs", "xs", 1))
        met = met.repartition("key", "xc", "qc").sortWithinPartitions("key", "xc", "qc", "tag", "c")
        return materialise(best_of(met.transform(map_batches, rank, "q long, c long, score double")), "found")

    found = met_in(indexed, asking.transform(map_batches, probe, schema))
    reached = found.groupBy("q").agg(F.min("score").alias("cosine"), F.count("*").alias("n")).where(F.col("n") > k)  # its own class is among them
    further = asking.join(reached.withColumnRenamed("q", "class"), "class").select("class", "v", "cosine")
    more = met_in(indexed, further.transform(map_batches, probe, schema))
    lacking = asking.join(reached, asking["class"] == reached["q"], "left_anti")
    everything = lambda side: side.select(F.size("v").cast("long").alias("key"), F.col("class").alias("c"), "v")
    rest = met_in(everything(classes), everything(lacking)) if not lacking.isEmpty() else more.limit(0)
    best = best_of(found.unionByName(more).unionByName(rest))
    near = best.join(members.select(F.col("class").alias("c"), "vec_id"), "c")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n", "c")
    lists = queries.join(near, "q").where("vec_id <> query_id")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row of `embeddings` whose vec_id is divisible by 50 the 5 nearest rows found, by cosine."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
