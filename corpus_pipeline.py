"""Corpus pipeline: language, near-duplicates, repeats, mixture, sequences.

Each stage takes the documents that the stage before kept and returns documents, the last one packed
sequences. Rows are documents (doc_id, text, lang, source, n_chars); other columns do not travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.language import UNKNOWN, fit_language, identify
from tidewheel.llm.mixing import mix
from tidewheel.llm.near_duplicates import keep_one
from tidewheel.llm.packing import gpt_bytes, pack
from tidewheel.llm.repeats import remove_repeats
from tidewheel.sources.shared import materialise
from tidewheel.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL has no string kernels, samplings or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. Null texts and texts without a letter go, all others stay, however short or
    long. Rows are judged one by one, so repeated rows and ids share their fate; empty input stays empty."""
    found = identify(docs.select(*COLUMNS), fit_language(docs))
    return found.where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id (null ids last, ties by hash of the text).

    Texts decide: different texts that share an id, or have none, all stay unless another stands for
    them. Of rows that repeat id and text the least by language, source and length stays. Null texts
    count as empty. Empty input stays empty.
    """
    return keep_one(docs.select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text without strings of 200 bytes that occur again anywhere; a text may become empty.

    Null texts become empty, null ids stay, repeated rows are occurrences of their own, so both lose
    what they share. Very long texts are read in pieces. Empty input stays empty.
    """
    kept = remove_repeats(docs, keep_text=True, carry=["lang", "source"])
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, by temperature, in order of the mixture.

    Rows are stored by position, so sources interleave by weight and copies are a pass apart. A null
    source is a source, rows without tokens go with their source, repeated rows are documents of their
    own. Empty input stays empty.
    """
    mixed, _ = mix(docs, max_repeats=2.0)
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents laid into sequences of at most 1024 tokens.

    Null and empty texts are an end id, repeated rows are documents of their own, long texts are cut
    into full sequences first. Empty input gives no rows.
    """
    return pack(docs, gpt_bytes())


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeats), ("mixing sources", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
