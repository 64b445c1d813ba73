import hashlib
import random
from collections import Counter

import pyarrow as pa
from compare import same
from pyspark.sql import functions as F

from tidewheel.llm import repeats


def brute(docs):
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_bytes", F.lit("clash")).repartition(parts)
    got = sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=repr)
    want = brute(docs)
    assert [g for g in got if g not in set(want)] == [] and got == want


def planted(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))[: 6 * n]
    passages = [text(80)[:n] for n in (150, 199, 200, 201, 230, 300, 420)]
    docs = []
    for i in range(60):
        parts = [text(r.randint(1, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 20)
            parts += [p[a:] if r.random() < 0.5 else p, text(r.randint(0, 30))]
        docs.append((i, "".join(parts)))
    docs += [(100, docs[1][1]), (101, docs[2][1][:-30] + "?" + docs[2][1][-29:]), (102, "z" * 1000), (103, "ab" * 300), (104, None), (105, ""), (106, "short"), (107, "y" * 200), (None, text(90)), (None, docs[3][1]), (108, "once " * 10)]
    return docs + [(200, docs[5][1]), (200, docs[5][1])]


def test_planted(spark):
    check(spark, planted())


def test_crowded_halves(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 2)
    check(spark, planted(4))


def test_whole_table(spark):
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()])


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert same(repeats.op3_repeats(spark, sf), repeats.OP3_SQL, sf) == "same"


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_parsed_in_pieces(monkeypatch):
    """Wherever a text is cut, each start is in one context, and equal strings share the half that is compared."""
    monkeypatch.setattr(repeats, "LONG", 333)
    docs = [t for _, t in planted(5) if t]
    docs += ["".join(docs[:12]), "".join(docs[5:15])]
    keys = {}
    for i, text in enumerate(docs):
        data = text.encode()
        for _, _, c in repeats.parsed(pa.array([text])):
            for i0, i1, t, r, left, base in zip(*[c[n].tolist() for n in ("i0", "i1", "t", "r", "l", "base")]):
                for start in range(i0, i1 + 1):
                    place = (i, start - base)
                    assert place not in keys
                    keys[place] = (data[place[1] : place[1] + 200], r if start >= t - repeats.HALF else left)
    assert len(keys) == sum(max(0, len(t.encode()) - 199) for t in docs)
    of = {}
    for string, key in keys.values():
        assert key and of.setdefault(string, key) == key


def test_a_text_of_megabytes(spark):
    r = random.Random(8)
    long = "".join(r.choices("abcdefgh ", k=3_000_000))
    passage = long[1_048_500:1_048_900]  # across the end of a piece
    df = spark.createDataFrame([(1, long), (2, "before#" + passage + "#after"), (3, "q" * 1_500_000)], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in repeats.remove_repeats(df).collect()}
    assert got == {1: (400, 1), 2: (400, 1), 3: (1_500_000, 1)}
