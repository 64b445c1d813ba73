import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewheel.llm import components as components_module
from tidewheel.llm import near_duplicates as nd
from tidewheel.llm.components import components
from tidewheel.llm.texts import buffers


def counted(text):
    """Five-word shingles of a text and how often it has them; a shorter text is one shingle."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def weighed(texts):
    every = [counted(t) for t in texts]
    frequency = Counter(s for c in every for s in c)
    return [{s: n * math.log1p(len(texts) / frequency[s]) for s, n in c.items()} for c in every]


def similarity(a, b):
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def brute(docs):
    """doc -> least id of its component of weighted Jaccard links, all pairs with a common shingle compared."""
    texts = [t or "" for _, t in docs]
    vectors = weighed(texts)
    having, same = defaultdict(list), defaultdict(list)
    for i, v in enumerate(vectors):
        same[texts[i]].append(i)
        if same[texts[i]][0] == i:  # copies are joined below
            for s in v:
                having[s].append(i)
    pairs = {(a, b) for ids in having.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    joined = [(g[0], x) for g in same.values() for x in g[1:]] + [p for p in pairs if similarity(vectors[p[0]], vectors[p[1]]) >= 0.8]
    for a, b in joined:
        root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least[find(i)], d)
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit("clash")).repartition(3)
    rows = nd.classes(df).collect()
    want = brute(docs)
    assert {r["doc_id"]: r["class_id"] for r in rows} == want
    assert sorted(r["doc_id"] for r in rows if r["first"]) == sorted(set(want.values()))
    texts = dict(docs)
    vectors = dict(zip(texts, weighed(list(texts.values())), strict=True))
    members = defaultdict(set)
    for d, c in want.items():
        members[c].add(d)
    for r in rows:  # a link is a text of the class at the similarity named
        others = {texts[d] or "" for d in members[r["class_id"]]} - {texts[r["doc_id"]] or ""}
        assert (r["n_links"] > 0) == (len(others) > 0) == (r["similarity"] is not None)
        if others:
            own = [similarity(vectors[r["doc_id"]], vectors[d]) for d in members[r["class_id"]] if (texts[d] or "") in others]
            assert min(abs(x - r["similarity"]) for x in own) < 1e-5 and r["similarity"] >= 0.8 - 1e-9


def test_whole_table(spark):
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()])


def variants(n, words=200, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for i in range(n):
        own = list(base)
        for at in rng.integers(0, words, int(rng.integers(1, 5))):
            own[at] = f"x{i}y{at}"
        out.append((i, " ".join(own)))
    return out


def test_crowd_of_near_copies_with_small_rounds(spark, monkeypatch):
    monkeypatch.setattr(nd, "PIVOTS", 3)
    monkeypatch.setattr(nd, "MEMBERS", 5)
    check(spark, variants(24))


def test_crowd_with_few_bytes_of_pivots(spark, monkeypatch):
    monkeypatch.setattr(nd, "PIVOT_BYTES", 3000)
    monkeypatch.setattr(nd, "MEMBERS", 16)
    check(spark, variants(14, seed=2))


def test_pivots_compare_as_pairs_do():
    texts = [t for _, t in variants(20, 60)] + ["one", "two three four five six", "two three four five six seven", "long " * 50]
    n = len(nd.weighed(*buffers(pa.array(texts)))[0])
    own = nd.vectors(texts, np.linspace(0.5, 3, n).astype(np.float32))
    table = nd.Pivots(own[3:])
    for v in own:
        assert np.allclose(table.similarity(v), [nd.weighted_jaccard(p, v) for p in own[3:]])
    assert len(nd.Pivots([]).similarity(own[0])) == 0


def test_odd_texts(spark):
    check(spark, [(1, None), (2, ""), (3, "a"), (4, "a"), (5, "!!!"), (6, "one two three"), (7, "one two three"), (8, "one two four"), (9, "long " * 5000), (10, "long " * 5000 + "x")])
    assert nd.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    """Texts decide: different ones of an id, or of none, are classed each by itself."""
    near = variants(2)[0][1]
    df = spark.createDataFrame([(None, "x y"), (None, "z"), (3, "x y"), (3, "x y"), (4, "one"), (4, "two"), (None, near + " end"), (9, near), (None, "z")], "doc_id long, text string")
    got = [(r["doc_id"], r["text_id"], r["class_id"], r["first"]) for r in nd.classes(df).collect()]
    want = [(None, 3, 3, False), (None, None, None, True), (None, None, None, True), (3, 3, 3, True), (3, 3, 3, True), (4, 4, 4, True), (4, 4, 4, True), (None, None, 9, False), (9, 9, 9, True)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_components_of_tasks_that_pass_on_early(spark, monkeypatch):
    monkeypatch.setattr(components_module, "AT_ONCE", 4)
    edges = [(i, i * 7 % 50) for i in range(50)] + [(200 + i, 300 - i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    alone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {(x, find(x)) for x in root if x not in alone}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100)}


def test_frequencies_are_of_all_documents(spark):
    """The same two texts are alike or not, as other documents make what they share common or rare."""
    base = [f"s{i}" for i in range(26)]
    a, b = " ".join(base), " ".join(base[:24] + ["other", "end"])
    shared = [(10 + i, " ".join(base[:24])) for i in range(30)]
    apart = [(100 + i, " ".join(base[20:24] + [w, x, f"k{i}"])) for i in range(30) for w, x in [["other", "end"]]] + [(200 + i, " ".join(base[20:26]) + f" m{i}") for i in range(30)]
    few, many = brute([(1, a), (2, b), *shared]), brute([(1, a), (2, b), *apart])
    assert few[2] == 2 and many[2] == 1
    for docs in ([(1, a), (2, b), *shared], [(1, a), (2, b), *apart]):
        check(spark, docs)


def test_shrunk_hashes_come_back():
    for values in ([], [0], [2**64 - 1], [1, 2, 2**48, 2**63, 2**64 - 1], np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))):
        values = np.array(values, np.uint64)
        assert (nd.restored(*nd.shrunk(values)) == values).all()
