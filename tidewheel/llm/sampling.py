"""Bounded, repeatable samples of documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_GROUPS = 48
SAMPLE_BYTES = 32 << 20


def first_by_hash(df: DataFrame, group: str, n: int, doc_id: str = "doc_id", most_groups: int = MOST_GROUPS) -> DataFrame:
    """(group, doc_id, k): the `n` ids of each group that come first by hash, ties to the smaller id; k numbers them.

    Null ids and groups are left out, an id of a group counts once, and of more than `most_groups` groups
    those with the most ids are taken. Only ids whose hash is below a bound, set by the number of ids of
    the group, are sorted: twice as many as wanted and 200, so a group of any size is little work.
    """
    h = F.xxhash64(doc_id)
    known = df.select(group, doc_id).where(F.col(group).isNotNull() & F.col(doc_id).isNotNull())
    sizes = known.groupBy(group).agg(F.approx_count_distinct(doc_id).alias("__n")).orderBy(F.desc("__n"), group).limit(most_groups)
    bound = F.least(F.lit(1.0), (2 * n + 200) / (0.8 * F.col("__n"))) * 2.0**64 - 2.0**63
    few = known.join(F.broadcast(sizes), group).where(h.cast("double") <= bound).select(group, doc_id).distinct()  # most_groups rows
    return few.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(h, doc_id))).where(F.col("k") <= n)


def sampled_texts(docs: DataFrame, ids: DataFrame, group: str, sample_bytes: int = SAMPLE_BYTES) -> list:
    """Rows (group, doc_id, text) of a bounded table of ids, in order of hash: `sample_bytes` of text a group at most.

    Null texts are left out, as is a text of over a sixteenth of the bytes; of repeated ids the least
    text is used.
    """
    size = F.octet_length("text")
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (size <= sample_bytes // 16)).join(F.broadcast(ids.select(group, "doc_id")), "doc_id")
    one = found.groupBy(group, "doc_id").agg(F.min("text").alias("text"))
    order = Window.partitionBy(group).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("upto", F.sum(size).over(order)).where(F.col("upto") <= sample_bytes).orderBy(F.xxhash64("doc_id"), "doc_id", group).select(group, "doc_id", "text").collect()
