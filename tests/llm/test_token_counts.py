import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidewheel.llm.token_counts import count_tokens, counter, splits_at_spaces, whole_tokens

PATH = P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", " a", "a ", "a  b", "a\n b", "▁", "a▁b", "<s> </s> <unk>", "é日\x00", "x" * 100_000, "word " * 30_000, "\n", "\t \t"]


def test_shortcut_is_proven():
    found = counter(PATH)
    assert splits_at_spaces(found.processor) and len(whole_tokens(found.processor)) > 10_000
    assert all(len(found.processor.encode(w)) == 1 for w in list(found.proven)[:500] if w)


def test_random_texts_equal_the_library():
    found, r = counter(PATH), random.Random(2)
    texts = ["".join(r.choice([" ", "  ", "the", "a", "\n", "é", "日", ".", "▁", "ing", "\t", "<s>"]) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    assert found.count(texts) == [len(found.processor.encode(t)) for t in texts]


def test_table_equals_the_library(spark):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((tuple(r) for r in count_tokens(df, PATH, limit=300, keep=["doc_id"]).collect()), key=repr)
    want = [(d, len((t or "").encode()), n := len(plain.encode(t)) if t else 0, n > 300) for d, t in docs]
    assert got == sorted(want, key=repr)


def test_empty_and_all_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, extra int")
    out = count_tokens(df, PATH)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "extra", "n_bytes", "n_tokens", "over_limit"]
    with pytest.raises(Exception):
        count_tokens(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "/no/such/model").collect()
