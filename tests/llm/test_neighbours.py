import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm.neighbours import Hashing, op4_neighbours, search

SF = "/root/testdata/sf0.1"


def brute(ids, vectors, queries, k):
    x = np.array(vectors, dtype=float)
    out = {}
    for q in queries:
        v = x[ids.index(q)]
        score = x @ v / np.linalg.norm(x, axis=1) / np.linalg.norm(v)
        order = sorted((-round(s, 12), i) for s, i in zip(score, ids, strict=True) if i != q)
        out[q] = [i for _, i in order[:k]]
    return out


def test_recall_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows], [r["vec_id"] for r in rows if r["vec_id"] % 50 == 0], 5)
    got = {}
    for r in op4_neighbours(spark, SF).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum(len(set(got.get(q, [])) & set(v)) for q, v in want.items())
    assert hits / sum(map(len, want.values())) >= 0.93


def test_odd_vectors_ties_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in search(df, F.col("vec_id") == 0, k=4).orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 2, 3, 10] and [g[1] for g in got] == [1, 2, 3, 4]
    assert search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_chunked_cells_give_the_same(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    asks = F.col("vec_id") % 10 == 0
    whole, cut = (sorted(map(tuple, search(df, asks, chunk=c, query_chunk=c).collect())) for c in (4096, 7))
    assert [w[:3] for w in whole] == [c[:3] for c in cut]
    assert [w[3] for w in whole] == pytest.approx([c[3] for c in cut], abs=1e-12)


def test_few_vectors_are_searched_whole(spark):
    rng = np.random.default_rng(3)
    for n in (3, 7, 20):
        rows = [(i, rng.normal(size=64).tolist()) for i in range(n)]
        got = {}
        for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 3, k=5).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        want = brute([i for i, _ in rows], [v for _, v in rows], [0, 1, 2], 5)
        assert all(len(got[q]) == min(5, n - 1) for q in want)
        assert n > 7 or got == want


def visited(x, queries, hashing, k=5):
    """Share of the vectors that a query meets, and recall, by looking at every cell, without Spark."""
    keys = hashing.keys(hashing.cells(x)[0], x.shape[1])
    share = hits = 0.0
    for q in queries:
        score = x @ x[q]
        score[q] = -2
        want = set(np.argsort(-score, kind="stable")[:k].tolist())
        seen = np.zeros(len(x), bool)
        cosine = None
        for _ in range(2):
            for t, own in enumerate(hashing.probes(x[q], cosine)):
                blank = np.zeros((len(own), hashing.tables, hashing.hashes), np.int64)
                blank[:, t] = own
                seen |= np.isin(keys[:, t], hashing.keys(blank, x.shape[1])[:, t])
            seen[q] = False
            cosine = float(np.sort(score[seen])[-k]) if seen.sum() >= k else -1.0
        share += seen.mean() / len(queries)
        hits += len(want & set(np.flatnonzero(seen).tolist())) / k / len(queries)
    return share, hits


def test_near_neighbours_are_found_in_fewer_cells_of_larger_tables():
    rng = np.random.default_rng(1)
    shares = []
    for n in (2_000, 60_000, 400_000):
        centres = rng.normal(size=(n // 50, 64))
        x = centres[rng.integers(0, len(centres), n)] + 0.5 * rng.normal(size=(n, 64))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        share, recall = visited(x, range(0, n, n // 20), Hashing.of_size(n))
        assert recall >= 0.93
        shares.append(share)
    assert shares[0] > shares[1] > shares[2]
