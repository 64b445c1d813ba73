import base64
import hashlib
import random
from functools import lru_cache

import pytest
from compare import same
from pyspark.sql import functions as F

from tidewheel.llm import fingerprints as fp

M = (1 << 64) - 1
POWERS = [pow(fp._BASE, j, 1 << 64) for j in range(24)]
TABLE = fp._TABLE.tolist()


def shingles(text):
    data = text.encode()
    return {data[i : i + 24] for i in range(max(1, len(data) - 23))} if data else set()


def name(shingle):
    """The hash of one shingle, letter by letter, in plain integers."""
    x = sum(TABLE[c] * p for c, p in zip(shingle, POWERS)) + len(shingle) & M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


@lru_cache(maxsize=None)
def printed(text):
    every = sorted(map(name, shingles(text)))
    low = [h for h in every if h < (1 << 64) // 16]
    digest = "" if low else hashlib.md5(b"".join(h.to_bytes(8, "little") for h in every)).hexdigest()
    return f"1/16:{base64.b64encode(b''.join(h.to_bytes(8, 'little') for h in low)).decode()}:{digest}", set(low)


def alike(a, b):
    (x, s), (y, t) = printed(a), printed(b)
    return len(s & t) / len(s | t) if s | t else float(x == y)


def brute(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(text)[0], printed(edited)[0], alike(text, edited), alike(text, after))
    return out


def check(spark, docs, ranges=None):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in fp.fingerprint_with_next(df, block=3000, ranges=ranges).collect()}
    assert got == brute(docs)


@pytest.fixture(scope="module")
def some(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 1200").limit(40).collect()
    return [tuple(r) for r in docs]


def test_table_and_odd_texts(spark, some):
    check(spark, [*some, (10_000, None), (10_001, ""), (10_002, "é" * 9), (10_003, "one two"), (10_004, some[0][1]), (10_005, "word " * 3000), (10_006, "!!!"), (10_007, "???")])


def test_more_ranges_than_documents(spark, some):
    check(spark, some[:9], ranges=40)


def test_single_and_empty(spark):
    check(spark, [(5, "a lone document of a few words")])
    assert fp.fingerprint_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "x"), (None, None), (1, "same"), (1, "same"), (1, "same")], "doc_id long, text string")
    got = fp.fingerprint_with_next(df).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in got) == [(False, 4)] * 3 + [(True, 0), (True, 1)]
    assert sorted(r["near_next"] for r in got if r["doc_id"]) == [0, 1, 1]


@pytest.mark.parametrize("ranges", [1, 7, 30])
def test_an_id_that_holds_most_rows_is_divided(spark, ranges):
    """300 of 340 rows share an id; together they must follow each other in one cycle."""
    r = random.Random(4)
    texts = ["".join(r.choice("abcdef ") for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame([(7, t) for t in texts] + [(i, f"text of {i} " * 9) for i in range(100, 140)] + [(7, texts[0])] * 5, "doc_id long, text string").repartition(4)
    rows = fp.fingerprint_with_next(df, ranges=ranges).collect()
    assert len(rows) == 345
    first = sorted(((7, t) for t in [*texts, *[texts[0]] * 5]), key=lambda x: fp_tie(spark, x[1]))
    chain = [*sorted(((i, f"text of {i} " * 9) for i in range(100, 140)), reverse=True), *first]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + chain[(i + 1) % len(chain)][1][: len(t) // 2]).encode()).hexdigest() for i, (_, t) in enumerate(chain))
    assert sorted(r["edited_sha256"] for r in rows) == want


_ties = {}


def fp_tie(spark, text):
    if text not in _ties:
        _ties[text] = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    return _ties[text]


def test_divided_ranges_keep_the_order():
    import numpy as np

    cut = fp.Ranges([5, 5, 5, 9, 12, 12])
    p, tie = np.repeat(np.arange(15), 200), np.tile(np.linspace(-(2**63), 2**63 - 2048, 200).astype(np.int64), 15)
    b = cut.of(p, tie)
    assert (np.diff(b) >= 0).all() and b.min() == 0 and b.max() == len(cut) - 1 and len(set(b[p == 5])) == 3


def test_sketches_merge_and_contain():
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(3000, 3400))
    whole, part = fp.sketch(a), fp.sketch(b)
    assert fp.containment(part, whole) > 0.9 and fp.containment(whole, part) < 0.3
    for x, y in ((a, b), (a[:300], b[:300]), (a[:600], a[200:700]), ("foo " * 600, b)):
        merged, low = fp.merge(fp.sketch(x), fp.sketch(y)), sorted(h for h in map(name, shingles(x) | shingles(y)) if h < (1 << 64) // 16)
        assert merged[0].tolist() == low
    assert fp.encode(fp.decode(fp.encode(whole))) == fp.encode(whole) and fp.encode(fp.decode(fp.encode(fp.sketch("a")))) == fp.encode(fp.sketch("a"))
    assert fp.likeness(fp.sketch(""), fp.sketch("")) == 1.0


def test_repetitive_short_and_lettered_texts():
    """Unrelated texts are unlike, however little their sketches hold; equal ones are alike."""
    texts = [f"{w} " * 600 for w in "foo bar baz one two six ten red".split()] + ["!!!", "???", "...", "a", "b", "a few words", "some more words"]
    own = [fp.sketch(t) for t in texts]
    for i, a in enumerate(own):
        assert [fp.likeness(a, b) for b in own] == [float(i == j) for j in range(len(own))]


def test_estimates_are_near_the_truth(some):
    texts = [t for _, t in some if len(t) > 600]
    for a, b in zip(texts, texts[1:]):
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        x, y = shingles(a), shingles(edited)
        assert fp.likeness(fp.sketch(a), fp.sketch(edited)) == pytest.approx(len(x & y) / len(x | y), abs=0.25)
    long = "".join(random.Random(1).choices("abcdefgh ", k=300_000))
    other = long[:200_000] + long[:100_000][::-1]
    assert fp.likeness(fp.sketch(long), fp.sketch(other)) == pytest.approx(0.5, abs=0.02)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = "".join(random.Random(2).choices("abc ", k=5000))
    whole = fp.encode(fp.sketch(text))
    monkeypatch.setattr(fp, "AT_ONCE", 100)
    assert fp.encode(fp.sketch(text)) == whole == printed(text)[0]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert same(fp.op8_fingerprints(spark, sf), fp.OP8_SQL, sf) == "same"
