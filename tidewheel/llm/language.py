"""Language identification by hierarchical discrimination.

Texts become counts of hashed byte 2-, 3- and 4-grams of their letters. Linear support vector machines,
fitted by dual coordinate descent, first choose the language family, one family against another; then
one-versus-one machines tell the languages of that family apart. Scoring is a table look-up for each
byte and machine, over whole texts, in arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewheel.llm.arrow import held_out, map_columns
from tidewheel.llm.sampling import MOST_GROUPS, SAMPLE_BYTES, first_by_hash, sampled_texts
from tidewheel.llm.texts import buffers, byte_slices
from tidewheel.sources.tables import table

UNKNOWN = "und"
BITS = 16
GRAMS = (2, 3, 4)
SCALE = 8.0
SHARPNESS = 3.0
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
    "indo-aryan": "hi bn ur mr gu pa ne".split(),
    "dravidian": "ta te kn ml".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue".split(),
    "japonic": ["ja"], "koreanic": ["ko"], "hellenic": ["el"], "austroasiatic": ["vi", "km"], "austronesian": "id ms tl jv".split(), "tai": ["th", "lo"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTERS = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def family(lang: str) -> str:
    """Family of a language code; a code that isn't known stands for itself."""
    return _FAMILY.get(lang.split("-")[0].split("_")[0].lower(), lang)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """For each n of GRAMS the bucket of the n-gram that starts at each byte."""
    codes = _LETTERS[data].astype(np.uint32)
    out, value = [], codes
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            out.append(np.zeros(0, np.uint32))
            continue
        value = value[:-1] | codes[n - 1 :] << np.uint32(8 * (n - 1))
        out.append((value * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS))
    return out


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse frequencies of one text; the last entry is the bias."""
    found, counts = np.unique(np.concatenate(grams(data)), return_counts=True)
    return np.append(found, 1 << BITS), np.append(counts * (SCALE / max(1, counts.sum())), 1.0).astype(np.float32)


def fit_svm(samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 4.0, epochs: int = 12) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by dual coordinate descent."""
    w, alpha = np.zeros((1 << BITS) + 1, np.float64), np.zeros(len(y))
    own = np.array([float(v @ v) for _, v in samples]) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            at, v = samples[i]
            gradient = y[i] * float(w[at] @ v) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - gradient / own[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w.astype(np.float32)


@dataclass
class LanguageModel:
    families: dict[str, list[str]] = field(default_factory=dict)
    #: (a, b) -> weights, above 0 for a; between families and between the languages of one.
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fit(texts: list[str], langs: list[str], snippets: int = 6, seed: int = 5) -> LanguageModel:
        """Learns from whole texts and from short cuts of them, so that short texts are known as well."""
        rng, samples, names = np.random.default_rng(seed), [], []
        for text, lang in zip(texts, langs, strict=True):
            data = np.frombuffer(text.lower().encode(), np.uint8)
            cuts = [data]
            for _ in range(snippets if len(data) > 40 else 0):
                n = int(rng.integers(8, min(len(data), 400)))
                at = int(rng.integers(0, len(data) - n + 1))
                cuts.append(data[at : at + n])
            samples += [features(x) for x in cuts]
            names += [lang] * len(cuts)
        model, langs_of = LanguageModel(), np.array(names, dtype=object)
        for lang in sorted(set(names)):
            model.families.setdefault(family(lang), []).append(lang)
        families_of = np.array([family(x) for x in names], dtype=object)
        tasks = [(pair, families_of) for pair in combinations(sorted(model.families), 2)]
        tasks += [(pair, langs_of) for members in model.families.values() for pair in combinations(members, 2)]
        for (a, b), of in tasks:
            rows = np.flatnonzero((of == a) | (of == b))
            model.machines[("f:" if of is families_of else "l:") + a, b] = fit_svm([samples[i] for i in rows], np.where(of[rows] == a, 1.0, -1.0))
        return model

    def margins(self, column: pa.Array) -> dict[tuple[str, str], np.ndarray]:
        data, at = buffers(column, lower=True)
        lengths = np.diff(at)
        total = np.maximum(1, sum(np.maximum(0, lengths - n + 1) for n in GRAMS))
        indices = grams(data)
        out = {}
        for key, w in self.machines.items():
            sums = np.zeros(len(lengths))
            for n, index in zip(GRAMS, indices, strict=True):
                running = np.concatenate([[0.0], np.cumsum(w[index], dtype=np.float64)])
                ends = np.minimum(np.maximum(at[1:] - n + 1, at[:-1]), len(running) - 1)
                sums += running[ends] - running[np.minimum(at[:-1], len(running) - 1)]
            out[key] = SCALE * sums / total + w[-1]
        return out

    @staticmethod
    def duel(names: list[str], margins: dict, prefix: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes, then by summed margins, and its least margin over the others."""
        votes, sums, least = (np.zeros((len(names), n)) for _ in range(3))
        least += np.inf
        for i, j in combinations(range(len(names)), 2):
            m = margins[prefix + names[i], names[j]]
            for k, mk in ((i, m), (j, -m)):
                votes[k] += mk > 0
                sums[k] += mk
                least[k] = np.minimum(least[k], mk)
        best = np.argmax(votes + 1e-6 * np.tanh(sums / 100), axis=0) if names else np.zeros(n, int)
        return best, least[best, np.arange(n)] if names else np.zeros(n)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n, names = len(column), sorted(self.families)
        if not names:
            return [UNKNOWN] * n, np.zeros(n)
        margins = self.margins(column)
        best, sure = self.duel(names, margins, "f:", n)
        lang = np.empty(n, dtype=object)
        for k, name in enumerate(names):
            rows = np.flatnonzero(best == k)
            own, own_sure = self.duel(self.families[name], {key: m[rows] for key, m in margins.items()}, "l:", len(rows))
            lang[rows] = np.array(self.families[name], dtype=object)[own]
            sure[rows] = np.minimum(sure[rows], own_sure)
        return lang.tolist(), 1 / (1 + np.exp(-SHARPNESS * np.minimum(sure, 30)))


def fit_language(docs: DataFrame, per_lang: int = 300, modulus: int = 3, rest: int = 1, most_langs: int = MOST_GROUPS) -> LanguageModel:
    """Fits on the `per_lang` rows of each language that come first by hash of their id, held-out rows left out.

    The sample is bounded by per_lang for each language, by the bytes of sampled_texts, and by
    `most_langs` languages, those with the most documents; so are the machines, of which there is one
    for each pair of families and of languages of a family. Ids are found alone, then their texts.
    """
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
    ids = first_by_hash(usable, "lang", per_lang, most_groups=most_langs).select("lang", "doc_id")
    rows = sampled_texts(usable, ids, "lang", SAMPLE_BYTES // 4)
    rows.sort(key=lambda r: r["lang"])  # stable: by hash within a language
    return LanguageModel.fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(df: DataFrame, model: LanguageModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) to the kept columns (all by default).

    A text that is null or has no letter gets `und` and 0; of a very long one all bytes count. Rows are independent; an empty table gives
    an empty one; columns that have the added names are replaced. Without any learned language every
    row gets `und`.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # 256 KB for each machine, whose number fit_language bounds

    def make():
        found = shared.value

        def compute(column: pa.Array, letters: pa.Array) -> list[pa.Array]:
            langs, scores = [], []
            for begin, end in byte_slices(column):
                a, b = found.predict(column.slice(begin, end - begin))
                langs += a
                scores.append(b)
            known = pc.fill_null(letters, False)
            scores = pa.array(np.concatenate(scores), pa.float64())
            return [pc.if_else(known, pa.array(langs, pa.string()), UNKNOWN), pc.if_else(known, scores, 0.0)]

        return compute

    keep = df.columns if keep is None else keep
    add = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_columns(df, keep, {"text": F.col(text), "letters": F.col(text).rlike(r"\p{L}")}, add, make)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of `documents`: whether it is held out, the language predicted (`und` without a letter) and a score."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_language(docs), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
