"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Words are normalised (lower case, look-alike digits and signs to letters, everything else dropped;
runs of single characters are joined first) and compared with landmark stems by the gap-weighted
subsequence kernel of order ORDER, so inserted characters and gaps cost little. Landmarks are stems
that labelled toxic documents have and others have not, and ordinary words. A word's kernel values
become Nyström features, and a linear machine, trained on labelled sentences as bags (a sentence is as
toxic as its worst word), gives each word a decision value. A document's worst words, calibrated on
documents of their own, make its score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewheel.llm.arrow import held_out, map_columns, slices
from tidewheel.llm.quality import fit_logistic, labelled_sample
from tidewheel.sources.tables import table

ORDER = 3
DECAY = 0.7
LETTERS = 20  # of a word at once; longer words are read in overlapping windows
SHARED = 0.7  # of a landmark's letters, else the kernel counts as 0
STEMS = (4, 12)
MEMO_ENTRIES = 400_000
MEMO_LONGEST = 48  # letters of a word that is remembered, so that the memo's bytes are bounded
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "|": "i"})
APART = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+|\n")


def normalise(word: str) -> str:
    inner = word.lower().strip("$|@!.,;:?*%&#\"'()[]")
    if not inner.isalpha():
        inner = "".join(filter(str.isalpha, inner.translate(LOOKALIKE).replace("!", "i")))
    return inner


def words_of(text: str) -> list[str]:
    """White-space words, and runs of single characters joined."""
    found = text.split()
    if APART.search(text):
        found += ["".join(m.group().split()) for m in APART.finditer(text)]
    return found


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes, 0 where a word has ended, and a 64-bit set of each word's letters."""
    out = np.zeros((len(words), LETTERS), np.uint32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)[:LETTERS]
    bits = np.where(out > 0, np.uint64(1) << (out % np.uint32(61)).astype(np.uint64), np.uint64(0))
    return out, np.bitwise_or.reduce(bits, axis=1)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _before(n: int) -> np.ndarray:
    """[i, j] = DECAY ** (i - 1 - j) for j < i."""
    i = np.arange(n)
    gap = i[:, None] - 1 - i[None]
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted kernel of order ORDER of each pair of rows (letter codes, 0 for none)."""
    out = np.zeros(len(a), np.float32)
    for at in range(0, len(a), 4096):
        x, y = a[at : at + 4096], b[at : at + 4096]
        x, y = x[:, : max(1, (x > 0).sum(1).max())], y[:, : max(1, (y > 0).sum(1).max())]
        same = ((x[:, :, None] == y[:, None]) & (x[:, :, None] > 0)).astype(np.float32) * np.float32(DECAY**2)
        left, right = _before(x.shape[1]), _before(y.shape[1]).T
        k = same
        for _ in range(ORDER - 1):
            k = same * (left @ (k @ right))
        out[at : at + 4096] = k.sum((1, 2))
    return out


@dataclass
class ToxicityModel:
    stems: list[str] = field(default_factory=list)
    alpha: np.ndarray | None = None
    bias: float = -1.0
    coefficients: tuple[float, ...] = (0.0,) * 4

    def prepare(self) -> ToxicityModel:
        self.codes, self.sets = encode(self.stems)
        self.own = np.sqrt(np.maximum(subsequence_kernel(self.codes, self.codes), 1e-9))
        self.needed = np.ceil(SHARED * popcount(self.sets)).astype(np.int64)
        self.memo: dict[str, float] = {}
        return self

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernel values [word, landmark]."""
        codes, sets = encode(words)
        out = np.zeros((len(words), len(self.stems)), np.float32)
        for at in range(0, len(words), 1 << 15):
            i, j = np.nonzero(popcount(sets[at : at + (1 << 15), None] & self.sets[None]) >= self.needed[None])
            i += at
            if len(i):
                value = subsequence_kernel(codes[i], self.codes[j]) / self.own[j]
                some = np.unique(i)
                own = np.ones(len(words), np.float32)
                own[some] = np.sqrt(np.maximum(subsequence_kernel(codes[some], codes[some]), 1e-9))
                out[i, j] = value / np.maximum(own[i], self.own[j])  # a word shorter than the landmark holds only part of it
        return out

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision value of each normalised word; long words count by their worst window."""
        if self.alpha is None:
            return np.full(len(words), self.bias)
        parts, of = [], []
        for i, w in enumerate(words):
            cuts = [w] if len(w) <= LETTERS else [w[k : k + LETTERS] for k in range(0, len(w) - LETTERS // 2, LETTERS // 2)]
            parts += cuts
            of += [i] * len(cuts)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, of, self.kernel(parts) @ self.alpha + self.bias)
        return out

    def values(self, texts: list[str]) -> np.ndarray:
        """[document, (worst decision value, log of the number of words above 0, log of their share)]."""
        split = [words_of(t) for t in texts]
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        missing = list(set().union(*split).difference(self.memo))
        plain = [normalise(w) for w in missing]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(plain))}
        decided = self.decide(list(distinct))
        self.memo.update((w, float(decided[distinct[p]])) for w, p in zip(missing, plain, strict=True))
        out = np.zeros((len(texts), 3))
        for i, words in enumerate(split):
            g = [self.memo[w] for w in words]
            above = sum(x > 0 for x in g)
            out[i] = max(g, default=self.bias), np.log1p(above), np.log1p(300 * above / (len(g) + 30))
        for long in [w for w in missing if len(w) > MEMO_LONGEST]:
            del self.memo[long]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        w = np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(np.clip(self.values(texts), -3, 9) @ w[:3] + w[3], -30, 30)))

    @staticmethod
    def choose_stems(toxic: list[set[str]], clean: list[set[str]], most: int = 48) -> list[str]:
        """Word beginnings that mark toxic documents, the longest of those that mark the same.

        A stem is in 3 % of the toxic documents and in 4 at least: rarer ones are more often chance than
        insult, as held-out documents show when the floor is 8 documents.
        """
        def beginnings(words):
            return {w[:n] for w in words for n in range(STEMS[0], min(len(w), STEMS[1]) + 1)}

        yes, no = Counter(), Counter()
        for count, docs in ((yes, toxic), (no, clean)):
            for words in docs:
                count.update(beginnings(words))
        least = max(4, round(0.03 * len(toxic)))
        rate = len(toxic) / max(1, len(clean))
        good = [s for s, n in yes.items() if n >= least and (no[s] + 0.5) * rate <= 0.15 * n]
        out: list[str] = []
        for s in sorted(good, key=lambda s: (-yes[s], -len(s), s)):
            if len(out) < most and not any(s.startswith(o) or o.startswith(s) for o in out):
                out.append(max((t for t in good if t.startswith(s) and yes[t] >= 0.9 * yes[s]), key=lambda t: (len(t), yes[t], t)))
        return out

    @staticmethod
    def fit(texts: list[str], labels: np.ndarray, prior: float, ordinary: int = 4, rounds: int = 3) -> ToxicityModel:
        """Landmarks, machine and curve; every fourth document of a class is for the curve alone."""
        labels = np.asarray(labels)
        fallback = ToxicityModel(coefficients=(0.0, 0.0, 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))))).prepare()
        if not len(labels) or labels.min() == labels.max():
            return fallback
        turn = np.zeros(len(labels), int)
        for c in (0, 1):
            turn[labels == c] = np.arange((labels == c).sum()) % 4
        bags, toxic_docs, clean_docs, seen, common = [], [], [], set(), Counter()
        for text, y, t in zip(texts, labels, turn, strict=True):
            if t != 3:
                sentences = [[w for w in map(normalise, words_of(s)) if len(w) >= ORDER] for s in SENTENCE.split(text)]
                every = frozenset(w for s in sentences for w in s)
                if every not in seen:  # copies count once
                    seen.add(every)
                    (toxic_docs if y else clean_docs).append(every)
                if not y:
                    common.update(every)
                bags.append((y, [s for s in sentences if s]))
        stems = ToxicityModel.choose_stems(toxic_docs, clean_docs)
        if not stems:
            return fallback
        plain = [w for w, _ in common.most_common() if 6 <= len(w) <= LETTERS][:ordinary]
        model = ToxicityModel(stems=[*stems, *plain]).prepare()
        k = model.kernel(model.stems)
        value, vector = np.linalg.eigh((k + k.T) / 2)
        root = (vector / np.sqrt(np.maximum(value, 1e-2))) @ vector.T  # Nyström map
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ss in bags for s in ss for w in s))}
        kernel = model.kernel(list(vocabulary))
        toxic_part = kernel[:, : len(stems)].max(1)
        bag_of = [(y, np.array([vocabulary[w] for w in s])) for y, ss in bags for s in ss]
        negative = np.unique([b[np.argmax(toxic_part[b])] for y, b in bag_of if not y])
        hard = negative[np.argsort(-toxic_part[negative], kind="stable")[:3000]]
        positive = [b for y, b in bag_of if y and toxic_part[b].max() > 0.5]
        if not positive:
            return fallback
        witness = np.array([b[np.argmax(toxic_part[b])] for b in positive])
        rng = np.random.default_rng(3)
        odd = []  # each stem with a character inserted, and with one gap more
        for s in stems:
            for _ in range(8):
                at = int(rng.integers(1, len(s)))
                odd.append(s[:at] + chr(97 + int(rng.integers(26))) + s[at:])
        odd_kernel = model.kernel(odd)
        w = None
        for _ in range(rounds):  # a toxic sentence is represented by its worst word
            rows = np.unique(witness)
            x = np.concatenate([kernel[rows], odd_kernel, kernel[hard]]) @ root
            y = np.concatenate([np.ones(len(rows) + len(odd)), -np.ones(len(hard))])
            w = fit_machine(x, y)
            decision = (kernel @ root) @ w[:-1]
            fresh = np.array([b[np.argmax(decision[b])] for b in positive])
            if (fresh == witness).all():
                break
            witness = fresh
        model.alpha, model.bias = (root @ w[:-1]).astype(np.float32), float(w[-1])
        rest = np.flatnonzero(turn == 3) if (turn == 3).any() else np.arange(len(labels))
        y = labels[rest].astype(float)
        weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
        values = np.concatenate([model.values(texts[i : i + 1]) for i in rest]) if len(rest) else np.zeros((0, 3))
        model.coefficients = tuple(fit_logistic(np.clip(values, -3, 9), y, weight, ridge=0.05))
        return model


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 60) -> np.ndarray:
    """Linear support vector machine (squared hinge, classes balanced) by dual coordinate descent; bias last."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    slack = 0.5 / (cost * np.where(y > 0, max(1, (y < 0).sum()) / max(1, (y > 0).sum()), 1.0))
    w, alpha, own = np.zeros(x.shape[1]), np.zeros(len(y)), (x * x).sum(1) + slack
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = max(0.0, alpha[i] - (y[i] * (w @ x[i]) - 1 + alpha[i] * slack[i]) / own[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1200, modulus: int = 3, rest: int = 1) -> ToxicityModel:
    """Fits on a sample that `per_class` bounds; held-out, unlabelled and null rows are left out."""
    return ToxicityModel.fit(*labelled_sample(docs, labels, "toxic", per_class, modulus, rest))


def score_toxicity(df: DataFrame, model: ToxicityModel, threshold: float = 0.7, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds score (probability of label 1) and predicted (1 from `threshold` on) to the kept columns.

    Null and empty texts share the score of an empty text; very long texts are read whole, and long
    words in overlapping windows. Rows are independent, an empty table gives an empty one, and columns
    that have the added names are replaced.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.stems, model.alpha, model.bias, model.coefficients))  # some hundred numbers

    def make():
        found = ToxicityModel(*shared.value).prepare()

        def compute(column: pa.Array) -> list[pa.Array]:
            return [pa.array(np.concatenate([found.scores(x) for x in slices(column)]), pa.float64())]

        return compute

    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted")]
    scored = map_columns(df, keep, {"text": F.col(text)}, StructType([StructField("score", DoubleType())]), make)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of `documents`: whether it is held out, its score from 0 to 1 and whether that is 0.7 or more."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
