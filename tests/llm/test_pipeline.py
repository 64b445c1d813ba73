import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidewheel.llm import mixing, near_duplicates, repeats
from tidewheel.sources.shared import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(5000, "12 34 !?", "en", "src0", 8), (5001, None, "en", "src0", 0), (5002, docs.first()["text"], "en", "src1", 9)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(cp.STAGES)
    assert list(stages) == ["language ID", "MinHash near-dedup", "suffix-array dedup", "mixing sources", "packing"]

    known = materialise(stages["language ID"](spark, docs, SF), "t1")
    assert known.columns == cp.COLUMNS
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in known.select("doc_id").collect()} == {5000, 5001}

    unique = materialise(stages["MinHash near-dedup"](spark, known, SF), "t2")
    want = {r["doc_id"] for r in near_duplicates.classes(known).where("first").collect()}
    ids = [r["doc_id"] for r in unique.select("doc_id").collect()]
    assert set(ids) == want and len(ids) == len(want) and 5002 not in want

    fresh = materialise(stages["suffix-array dedup"](spark, unique, SF), "t3")
    assert fresh.columns == cp.COLUMNS and fresh.count() == len(ids)
    data = {r["doc_id"]: r["text"].encode() for r in unique.collect()}
    seen = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    for r in fresh.collect():
        b = data[r["doc_id"]]
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + repeats.SPAN] = b"\1" * repeats.SPAN
        assert r["text"] == bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])

    mixed = materialise(stages["mixing sources"](spark, fresh, SF), "t4")
    assert mixed.columns == cp.COLUMNS and {r["doc_id"] for r in mixed.select("doc_id").collect()} == set(ids)
    place = {}
    for r in mixing.mix(fresh, max_repeats=2.0)[0].collect():
        place.setdefault(r["doc_id"], []).append(r["position"])
    files = sorted({r["f"] for r in mixed.selectExpr("input_file_name() AS f").collect()})
    stored = [r["doc_id"] for f in files for r in spark.read.parquet(f).collect()]
    assert sorted(stored) == sorted(d for d, p in place.items() for _ in p)
    assert all(a != b for a, b in zip(stored, stored[1:])), "copies of a document are not neighbours"
    at = sorted((p, d) for d, ps in place.items() for p in ps)
    assert stored == [d for _, d in at]

    rows = stages["packing"](spark, mixed, SF).collect()
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    for (d, text), n in texts.items():
        ids = [*exact.encode(text, add_special_tokens=False).ids, 0]
        own = [r for r in rows if r["doc_id"] == d]
        assert sum(r["length"] for r in own) == n * len(ids)
        first = [r for r in own if r["start"] == 0]
        assert len(first) == n and all(r["ids_crc32"] == zlib.crc32(np.array(ids[: r["length"]], "<u4").tobytes()) for r in first)


def test_run_and_empty(spark):
    assert cp.run(spark, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
        if empty.columns != cp.COLUMNS:
            break
        empty = materialise(empty, "none")


def test_near_duplicates_lose_no_text(spark):
    """Repeated and null ids, copies of every kind, a very long text and columns that do not belong."""
    long = " ".join(f"w{i}" for i in range(120_000))
    near = " ".join(f"v{i}" for i in range(300))
    rows = [(1, "first text here", "en", "a"), (1, "another text here", "en", "a"), (1, "another text here", "de", "b"), (2, "first text here", "en", "a"), (3, long, "en", "a"), (4, long + " end", "en", "a")]
    rows += [(None, "a text without id", "en", "a"), (None, "a text without id", "en", "b"), (None, near, "en", "a"), (7, near + " more", "en", "a"), (8, None, "en", "a"), (9, "", "en", "a"), (5, near + " other", "en", None)]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash", "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, class_id string, first string, block string").repartition(3)
    got = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in cp.near_duplicates(spark, df, SF).collect()]
    want = [rows[0], (1, "another text here", "de", "b"), rows[4], rows[6], rows[12], rows[10]]  # null and empty texts are copies
    assert sorted(map(str, got)) == sorted(map(str, want))
    docs = df.select(*cp.COLUMNS, "class_id", "first", "block")
    for name, stage in cp.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "odd").withColumns({c: F.lit("clash") for c in ("class_id", "block", "position", "lang_pred")})
    assert docs.count() > 0 and cp.packing(spark, docs, SF).count() > 0
