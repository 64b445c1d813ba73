"""Quality by compression: zstandard dictionaries built from good and from bad texts.

Each whole text is compressed window by window with either dictionary. The difference of the two
sizes over their sum says which kind of text it resembles; its own compression ratio says whether it
repeats itself. A logistic curve, fitted on other documents than the dictionaries, turns the two into
a probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewheel.llm.arrow import held_out, map_columns, slices
from tidewheel.llm.sampling import first_by_hash, sampled_texts
from tidewheel.sources.tables import table

WINDOW = 4096
DICTIONARY = 48 * 1024
LEVEL = 3


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    import zstandard

    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**options).compress
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **options).compress


def train_dictionary(texts: list[str]) -> bytes:
    """Dictionary of at most DICTIONARY bytes; with too few texts to train on, their bytes as they are."""
    import zstandard

    pieces = [b[i : i + WINDOW] for b in (t.encode() for t in texts) for i in range(0, len(b), WINDOW)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients (bias last) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class QualityModel:
    good: bytes = b""
    bad: bytes = b""
    coefficients: tuple[float, ...] = (0.0,) * 5

    def sizes(self, text: str) -> tuple[int, int, int]:
        data = text.encode()
        good, bad = _compressor(self.good), _compressor(self.bad)
        windows = [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]
        return len(data), sum(len(good(w)) for w in windows), sum(len(bad(w)) for w in windows)

    def features(self, texts: list[str]) -> np.ndarray:
        n, good, bad = np.array([self.sizes(t) for t in texts], dtype=float).reshape(-1, 3).T
        size, some = np.maximum(n, 1), n > 0
        difference = np.where(some, (bad - good) / np.maximum(good + bad, 1), 0.0)
        ratio = np.where(some, np.minimum(good, bad) / size, 0.5)
        return np.column_stack([10 * difference, 5 * ratio, 10 * ratio**2, np.log1p(n) / 4])

    def scores(self, texts: list[str]) -> np.ndarray:
        w = np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ w[:-1] + w[-1], -30, 30)))

    @staticmethod
    def fit(texts: list[str], labels: np.ndarray, prior: float) -> QualityModel:
        """Every other text of a class goes into its dictionary, the rest into the curve."""
        labels = np.asarray(labels)
        if not len(labels) or labels.min() == labels.max():
            return QualityModel(coefficients=(0.0, 0.0, 0.0, 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))))
        order = {c: np.flatnonzero(labels == c) for c in (0, 1)}
        model = QualityModel(*(train_dictionary([texts[i] for i in order[c][::2]]) for c in (1, 0)))
        rest = np.concatenate([order[c][1::2] if len(order[c]) > 1 else order[c] for c in (0, 1)])
        y = labels[rest].astype(float)
        weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
        model.coefficients = tuple(fit_logistic(model.features([texts[i] for i in rest]), y, weight))
        return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int, rest: int) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most `per_class` rows of each class, first by hash of the id, and the share of class 1.

    Held-out, unlabelled and null rows are left out, and ids that have labels of both classes. Ids are
    chosen from the labels alone; of repeated ids one text is used. See sampled_texts for the bound in bytes.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
    usable = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("__hi")).where("y = __hi").select("doc_id", "y")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = sampled_texts(docs, first_by_hash(usable, "y", per_class), "y")
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=int), counts.get(1, 0) / max(1, sum(counts.values()))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, modulus: int = 4, rest: int = 2) -> QualityModel:
    """Fits on a sample that `per_class` bounds; see labelled_sample."""
    return QualityModel.fit(*labelled_sample(docs, labels, "quality", per_class, modulus, rest))


def score_quality(df: DataFrame, model: QualityModel, threshold: float = 0.7, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds score (probability of label 1) and predicted (1 from `threshold` on) to the kept columns.

    Null and empty texts share one score, that of an empty text; very long texts are compressed window
    by window. Rows are independent, an empty table gives an empty one, and columns that have the added
    names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    def make():
        found = shared.value

        def compute(column: pa.Array) -> list[pa.Array]:
            return [pa.array(np.concatenate([found.scores(x) for x in slices(column)]), pa.float64())]

        return compute

    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted")]
    scored = map_columns(df, keep, {"text": F.col(text)}, StructType([StructField("score", DoubleType())]), make)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of `documents`: whether it is held out, its score from 0 to 1 and whether that is 0.7 or more."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
