"""Token counts by the whole-token shortcut.

A sentencepiece BPE vocabulary in which no piece holds a space mark behind another character lets no
merge cross the start of a run of spaces. A text is therefore the sum of its pre-tokens: the pieces
between the starts of space runs. Before any text is seen, every vocabulary string that starts with
the space mark is encoded alone; those that come back as exactly themselves are whole tokens and
count 1 by look-up. Only other pre-tokens run the merges, once for each worker while they stay in a
memo, which holds those of up to MEMO_LONGEST characters and is emptied at MEMO_ENTRIES, so it takes
less than 100 MB whatever the texts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidewheel.llm.arrow import map_columns, slices
from tidewheel.sources.tables import table

MARK = "▁"
MEMO_ENTRIES = 300_000
MEMO_LONGEST = 48
RUN_START = re.compile(r"(?<! ) ")


def whole_tokens(processor) -> dict[str, int]:
    """Vocabulary strings, without their space mark, that encode alone as one token."""
    proven = {"": 1} if len(processor.encode(" x")) - len(processor.encode("x")) in (0, 1) else {}
    strings = [p for p in (processor.id_to_piece(i) for i in range(processor.get_piece_size())) if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1]
    for piece, ids in zip(strings, processor.encode([p[1:] for p in strings], num_threads=1), strict=True):
        if len(ids) == 1 and processor.id_to_piece(ids[0]) == piece:
            proven[piece[1:]] = 1
    return proven


def splits_at_spaces(processor) -> bool:
    """No piece mixes a space mark with a character before it, and a lone mark is a piece."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces)


class PieceCounter:
    """Counts exactly as processor.encode would, without begin or end tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.splits = splits_at_spaces(self.processor)
        self.proven = whole_tokens(self.processor)
        self.memo = dict(self.proven)

    def pretokens(self, text: str) -> list[str] | None:
        """None: only the whole text can be encoded."""
        if not self.splits or MARK in text:
            return None
        if text[:1] == " " or "  " in text:
            return RUN_START.split(" " + text)[1:]
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pretokens(x) for x in texts]
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo = dict(self.proven)
        memo = self.memo
        missing = list(set().union(*(x for x in split if x is not None)).difference(memo))
        memo.update(zip(missing, map(len, self.processor.encode(missing, num_threads=1)), strict=True))
        counts = [0 if not text else len(self.processor.encode(text)) if parts is None else sum(map(memo.__getitem__, parts)) for text, parts in zip(texts, split, strict=True)]
        for long in [x for x in missing if len(x) > MEMO_LONGEST]:
            del memo[long]
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to the kept columns (all by default).

    Null and empty texts count 0 bytes and 0 tokens; very long texts are counted whole. Rows are independent: repeated rows and ties get
    the same figures, an empty table gives an empty one, and existing columns with the added names
    are replaced. `model_path` must exist on every executor.
    """

    def make():
        found = counter(model_path)

        def compute(column: pa.Array) -> list[pa.Array]:
            n = []
            for texts in slices(column):
                n += found.count(texts)
            return [pa.array(n, pa.int64())]

        return compute

    keep = df.columns if keep is None else keep
    sized = df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    keep = [*[c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")], "n_bytes"]
    counted = map_columns(sized, keep, {"text": F.col(text)}, StructType([StructField("n_tokens", LongType())]), make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of `documents`: its bytes, its tokens in piece_bpe_32k.model and whether they are over 4096."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
