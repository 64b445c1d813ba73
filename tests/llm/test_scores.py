"""Scores of the three classifiers, worked out again text by text in plain Python from what a model holds, and the rows they learn from."""

import math
import re
from functools import lru_cache
from itertools import combinations
from zlib import crc32

import pytest
import zstandard

from tidewheel.llm import language, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "?!", "ab", "x" * 9000, "i d i o t and 1d10t", "a b c dd e f", "wor" * 30, "Größe, çà", "日本語の文", "idiot " * 700]


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def tables(spark):
    return (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def with_odd(spark, docs):
    return docs.select("doc_id", "text").union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))


def test_quality_scores(spark):
    docs, labels = tables(spark)
    model = quality.fit_quality(docs, labels)
    tools = [
        zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        for d in (model.good, model.bad)
    ]
    rows = quality.score_quality(with_odd(spark, docs), model).collect()
    assert len(rows) == 1000 + len(ODD)
    for r in rows:
        data = (r["text"] or "").encode()
        good, bad = (sum(len(z.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for z in tools)
        seen = [10 * (bad - good) / (good + bad), 5 * min(good, bad) / len(data), 10 * (min(good, bad) / len(data)) ** 2] if data else [0.0, 2.5, 2.5]
        want = sigmoid(sum(w * x for w, x in zip(model.coefficients, [*seen, math.log1p(len(data)) / 4, 1.0], strict=True)))
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == (r["score"] >= 0.7)


@pytest.mark.parametrize("label,modulus,rest", [("quality", 4, 2), ("toxic", 3, 1)])
def test_labels_learned_from(spark, label, modulus, rest):
    """All usable rows of a class where the bound leaves room, else as many as it says, and none that is held out."""
    docs, labels = tables(spark)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    usable = {r["doc_id"]: r[label] for r in labels.collect() if r[label] in (0, 1) and crc32(str(r["doc_id"]).encode()) % modulus != rest}
    for bound in (10_000, 7):
        texts, y, prior = quality.labelled_sample(docs, labels, label, bound, modulus, rest)
        assert prior == pytest.approx(sum(usable.values()) / len(usable))
        for c in (0, 1):
            own, got = sorted(text[d] for d, v in usable.items() if v == c), sorted(t for t, v in zip(texts, y, strict=True) if v == c)
            assert got == own if bound > len(own) else len(got) == bound and set(got) <= set(own)


def test_language_scores(spark):
    docs, _ = tables(spark)
    model = language.fit_language(docs)
    machines = {k: w.tolist() for k, w in model.machines.items()}

    def buckets(text):
        codes = [c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()]
        for n in (2, 3, 4):
            for i in range(len(codes) - n + 1):
                yield (int.from_bytes(bytes(codes[i : i + n]), "little") * 2654435761 + n * 0x9E3779B1) % (1 << 32) >> 16

    def winner(names, margin):
        votes = [(sum(margin(a, b) > 0 for b in names if b != a), sum(margin(a, b) for b in names if b != a)) for a in names]
        best = names[max(range(len(names)), key=lambda i: (votes[i], -i))]
        return best, min((margin(best, b) for b in names if b != best), default=math.inf)

    rows = language.identify(with_odd(spark, docs.where("length(text) < 4000")), model).collect()
    for r in rows:
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        found = list(buckets(text))

        @lru_cache(maxsize=None)
        def value(key):
            w = machines[key]
            return 8 * sum(w[b] for b in found) / max(1, len(found)) + w[-1]  # noqa: B023

        def margin(kind):
            return lambda a, b: value((kind + a, b)) if (kind + a, b) in machines else -value((kind + b, a))  # noqa: B023

        kin, sure = winner(sorted(model.families), margin("f:"))
        lang, own = winner(model.families[kin], margin("l:"))
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(sigmoid(3 * min(sure, own, 10)), abs=1e-5)


def test_toxicity_scores(spark):
    docs, labels = tables(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert model.stems

    @lru_cache(maxsize=None)
    def spelled(word):
        """Weight of each subsequence of three letters, and the root of the word's kernel with itself."""
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            at = word[i] + word[j] + word[k]
            out[at] = out.get(at, 0.0) + 0.7 ** (k - i + 1)
        return out, math.sqrt(max(sum(v * v for v in out.values()), 1e-9))

    def kernel(word, stem):
        few = {ord(c) % 61 for c in stem}
        if len(few & {ord(c) % 61 for c in word}) < math.ceil(0.7 * len(few)):
            return 0.0
        (a, x), (b, y) = spelled(word), spelled(stem)
        return sum(v * b.get(s, 0.0) for s, v in a.items()) / y / max(x, y)

    signs = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "|": "i", "!": "i"}

    @lru_cache(maxsize=None)
    def decision(word):
        inner = word.lower().strip("$|@!.,;:?*%&#\"'()[]")
        if not inner.isalpha():
            inner = "".join(c for c in (signs.get(c, c) for c in inner) if c.isalpha())
        parts = [inner] if len(inner) <= 20 else [inner[k : k + 20] for k in range(0, len(inner) - 10, 10)]
        return max(sum(float(a) * kernel(p, s) for a, s in zip(model.alpha, model.stems, strict=True)) for p in parts) + model.bias

    def words(text):
        """Words, and runs of three single characters or more as one."""
        found, run, end = text.split(), "", -2
        for m in [*re.finditer(r"\S+", text), None]:
            if m is None or len(m[0]) > 1 or m.start() != end + 1:
                found += [run] * (len(run) > 2)
                run = ""
            if m is not None:
                run += m[0] if len(m[0]) == 1 else ""
                end = m.end()
        return found

    rows = toxicity.score_toxicity(with_odd(spark, docs), model).collect()
    for r in rows:
        g = [decision(w) for w in words(r["text"] or "")]
        above = sum(x > 0 for x in g)
        seen = [max(g, default=model.bias), math.log1p(above), math.log1p(300 * above / (len(g) + 30))]
        want = sigmoid(sum(w * x for w, x in zip(model.coefficients, [*(max(-3, min(9, x)) for x in seen), 1.0], strict=True)))
        assert r["score"] == pytest.approx(want, abs=1e-4) and r["predicted"] == (r["score"] >= 0.7)
