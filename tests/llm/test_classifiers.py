"""Held-out accuracy, defined results for odd rows, and blindness to labels that must not be learned."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import language, quality, toxicity
from tidewheel.llm.arrow import held_out

SF = "/root/testdata/sf0.1"
MANY = "/root/testdata/check_h"
ODD = [(1, None), (2, ""), (3, "   "), (4, "12 !? 34"), (5, "x" * 60_000), (6, "日本語"), (7, "the and of"), (7, "the and of"), (None, "the and of")]


def auc(rows):
    good, bad = np.array([s for s, y in rows if y]), np.array([s for s, y in rows if not y])
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


def scored(spark, query, label, sf=SF):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    return [(r["score"], r[label], r["predicted"]) for r in query(spark, sf).where("held_out").join(labels, "doc_id").collect()]


def test_quality(spark):
    rows = scored(spark, quality.op1_quality, "quality")
    assert auc([r[:2] for r in rows]) > 0.98
    assert np.mean([p == y for _, y, p in rows]) > 0.96
    assert all(p == (s >= 0.7) for s, _, p in rows)


@pytest.mark.skipif(not os.path.isdir(MANY), reason="no table with many labels")
def test_toxicity_with_many_labels(spark):
    rows = scored(spark, toxicity.op10_toxicity, "toxic", MANY)
    assert auc([r[:2] for r in rows]) > 0.99
    assert np.mean([p for _, y, p in rows if y]) > 0.95 and np.mean([p for _, y, p in rows if not y]) < 0.01


def test_toxicity_with_few_labels(spark):
    """About 300 toxic documents to learn from; of those in English one in sixteen has no insult at all."""
    rows = scored(spark, toxicity.op10_toxicity, "toxic")
    assert auc([r[:2] for r in rows]) > 0.9
    assert np.mean([p for _, y, p in rows if y]) > 0.5 and np.mean([p for _, y, p in rows if not y]) < 0.01


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = language.op9_language_id(spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_held_out_rows_are_never_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(held_out(F.col("doc_id"), 3, 1), F.lit("xx")).otherwise(F.col("lang")))
    a, b = language.fit_language(docs), language.fit_language(spoilt)
    assert a.families == b.families and all((a.machines[k] == b.machines[k]).all() for k in a.machines)


@pytest.mark.parametrize("kind", ["language", "quality", "toxicity"])
def test_odd_rows(spark, kind):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("clash"), "predicted": F.lit("clash"), "extra": F.lit(1)})
    if kind == "language":
        out = language.identify(df, language.fit_language(docs))
        got = {r["text"]: r for r in out.collect()}
        assert all((got[t]["lang_pred"], got[t]["score"]) == ("und", 0.0) for t in (None, "", "   ", "12 !? 34"))
        assert got["the and of"]["lang_pred"] == "en"
    else:
        m = quality if kind == "quality" else toxicity
        fit, score = (m.fit_quality, m.score_quality) if kind == "quality" else (m.fit_toxicity, m.score_toxicity)
        out = score(df, fit(docs, labels))
        got = {r["text"]: r for r in out.collect()}
        assert got[None]["score"] == got[""]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
        empty = fit(docs.limit(0), labels)
        assert score(df, empty).count() == len(ODD)
    assert out.count() == len(ODD) and "extra" in out.columns
    assert out.limit(0).count() == 0


def test_language_without_training_data(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "abc", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(docs, language.fit_language(docs)).collect()} == {"und"}


def test_string_kernel_against_enumeration():
    from itertools import combinations

    def slow(a, b):
        def weights(s):
            out = {}
            for idx in combinations(range(len(s)), toxicity.ORDER):
                key = "".join(s[i] for i in idx)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (idx[-1] - idx[0] + 1)
            return out

        x, y = weights(a), weights(b)
        return sum(v * y.get(k, 0) for k, v in x.items())

    words = ["idiot", "idxiot", "lowei", "abcabc", "ab", "xyzzy"]
    codes, _ = toxicity.encode(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert toxicity.subsequence_kernel(codes[i : i + 1], codes[j : j + 1])[0] == pytest.approx(slow(a, b), rel=1e-4)


def test_gapped_and_inserted_insults(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    base = "Then the erand of inthe was thon. "
    odd = ["idiot", "id.i.o.t", "i d i o t", "1d10t", "mor-on", "lo$er", "stupiid", "patheticc"]
    assert (model.scores([base + w + " in thon." for w in odd]) > 0.7).mean() >= 0.85
    assert model.scores([base * 20])[0] < 0.1
