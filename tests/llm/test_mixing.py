import hashlib
import math

import pytest
from compare import same
from pyspark.sql import functions as F

from tidewheel.llm import mixing


def brute(rows, max_repeats):
    """rows: (doc, source, tokens) -> sorted (source, doc, block, position)."""
    n = {}
    for _, s, t in rows:
        n[s] = n.get(s, 0) + t
    plan = mixing.temperature(n, max_repeats=max_repeats)
    out = []
    for s, total in n.items():
        own = [(d, t) for d, x, t in rows if x == s]
        passes, rest = divmod(plan.quotas[s], total) if total else (1, 0)
        way = plan.quotas[s] / total if total else 1.0
        place = lambda d, b: (b + int(hashlib.md5(f"{d}:{b}".encode()).hexdigest()[:13], 16) / 16**13) / way  # noqa: B023, E731
        out += [(s, d, b, place(d, b)) for b in range(passes) for d, _ in own]
        used = 0
        key = lambda x: hashlib.md5(f"{'' if x[0] is None else x[0]}:{passes}".encode()).hexdigest()  # noqa: B023, E731
        for d, t in sorted(own, key=key) if rest else ():
            used += t
            if used <= rest:
                out.append((s, d, passes, place(d, passes)))
    return sorted(out, key=repr)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert same(mixing.op5_mixing(spark, sf), mixing.OP5_SQL, sf) == "same"


@pytest.mark.parametrize("repeats,per_prefix,few", [(1.0, 4096, 10), (1.7, 3, 10), (3.5, 1, 10), (1.7, 3, 2)])
def test_blocks_against_brute_force(spark, monkeypatch, repeats, per_prefix, few):
    """With `few` = 2 there are more sources than reach the driver."""
    monkeypatch.setattr(mixing, "PER_PREFIX", per_prefix)
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = [(i, "big", 7 + i % 5) for i in range(300)] + [(1000 + i, "mid", 3) for i in range(40)] + [(2000 + i, None, 11) for i in range(9)] + [(3000, "none", 0), (3001, "none", 0), (3002, "mid", 0)]
    df = spark.createDataFrame([(d, s, t, "clash", "clash") for d, s, t in rows], "doc_id long, source string, t int, block string, position string")
    got, _ = mixing.mix(df, tokens=F.col("t").cast("long"), max_repeats=repeats)
    assert sorted(((r["source"], r["doc_id"], r["block"], r["position"]) for r in got.collect()), key=repr) == brute(rows, repeats)


def test_targets():
    n = {"a": 1_000_000, "b": 10_000, "c": 100}
    m = mixing.temperature(n, max_repeats=2.0)
    assert m.quotas["a"] == 1_000_000 and max(m.quotas[s] / n[s] for s in n) == pytest.approx(2.0, abs=0.01)
    assert all(m.quotas[s] >= n[s] for s in n) and sum(m.weights.values()) == pytest.approx(1)
    e = mixing.temperature(n, budget=500_000, max_repeats=None, entropy=0.8)
    assert -sum(w * math.log(w) for w in e.weights.values()) / math.log(3) == pytest.approx(0.8, abs=1e-3)
    assert sum(e.quotas.values()) == pytest.approx(500_000, abs=3)
    assert mixing.temperature({}).quotas == {} and mixing.temperature({"x": 0}).quotas == {"x": 0}
    assert mixing.temperature({"x": 5}, max_repeats=2.0).quotas == {"x": 5}


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, "a", None)], "doc_id long, source string, text string")
    assert mixing.mix(df)[0].count() == 3
    assert mixing.mix(df.limit(0))[0].count() == 0


def test_sources_interleave_and_copies_are_apart(spark):
    rows = [(i, "big", 10) for i in range(400)] + [(1000 + i, "small", 10) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, t long")
    got = sorted(mixing.mix(df, tokens=F.col("t"), max_repeats=2.0)[0].collect(), key=lambda r: r["position"])
    assert all(0 <= r["position"] <= 1 for r in got) and sum(r["source"] == "small" for r in got) == 80
    for quarter in range(4):
        part = got[quarter * len(got) // 4 : (quarter + 1) * len(got) // 4]
        assert 8 <= sum(r["source"] == "small" for r in part) <= 32
    assert all(a["doc_id"] != b["doc_id"] for a, b in zip(got, got[1:]))
    order = [r["doc_id"] for r in got if r["source"] == "small" and r["block"] == 1]
    assert order == sorted(order, key=lambda d: hashlib.md5(f"{d}:1".encode()).hexdigest())


@pytest.mark.parametrize("target", [dict(max_repeats=3.0), dict(max_repeats=None, entropy=0.7), dict(budget=5000, max_repeats=4.0), dict(budget=5000, max_repeats=None, entropy=0.9)])
def test_driver_and_spark_agree(spark, monkeypatch, target):
    df = spark.createDataFrame([(i, f"s{i % 7}", 1 + (i % 7) ** 3) for i in range(300)], "doc_id long, source string, t long")
    a = sorted(map(tuple, mixing.mix(df, tokens=F.col("t"), **target)[1].collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    c = sorted(map(tuple, mixing.mix(df, tokens=F.col("t"), **target)[1].collect()))
    assert [x[:3] + x[4:] for x in a] == [x[:3] + x[4:] for x in c] and [x[3] for x in a] == pytest.approx([x[3] for x in c])
