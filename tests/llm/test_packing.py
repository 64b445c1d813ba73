import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm.bpe import byte_bpe
from tidewheel.llm.packing import best_fit_decreasing, gpt_bytes, pack, pack_block


def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_ids_equal_the_library():
    bpe, exact, r = byte_bpe(*gpt_bytes()), library(), random.Random(1)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "é", "'s", "1", "²", "!", "<|endoftext|>", "日", "\xa0", "x\x1c", "\r\n", "the", "“", "\x85", "▁", "I'm", "ß"]
    for _ in range(5000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 10)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, text


def tightest(lengths, size):
    """Best-fit decreasing by looking at every window."""
    windows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w in range(len(windows)) if room[w] >= lengths[i]]
        if fits:
            w = min(fits, key=lambda w: room[w])
        else:
            w = len(windows)
            windows.append([])
            room.append(size)
        windows[w].append(lengths[i])
        room[w] -= lengths[i]
    return sorted(sorted(w) for w in windows)


@given(st.lists(st.integers(1, 64), max_size=60))
def test_tree_finds_the_tightest_window(lengths):
    windows = best_fit_decreasing(lengths, 64)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    room = sorted(64 - sum(lengths[i] for i in w) for w in windows)
    assert room == sorted(64 - sum(w) for w in tightest(lengths, 64))


@given(st.lists(st.integers(1, 63), max_size=60))
def test_blocks_keep_every_id_and_waste_little(lengths):
    pieces = [(i, 10, np.arange(n, dtype="<u4").tobytes(), n) for i, n in enumerate(lengths)]
    sequences = list(pack_block(pieces, 64, 4))
    got = defaultdict(dict)
    for s in sequences:
        n = sum(len(ids) // 4 for _, _, ids, _ in s)
        assert n >= 60 or n & (n - 1) == 0
        for doc, start, ids, _ in s:
            assert start not in got[doc] and ids
            got[doc][start] = ids
    assert {d: b"".join(x[1] for x in sorted(p.items())) for d, p in got.items()} == {d: ids for d, _, ids, _ in pieces}


def test_table_is_an_exact_round_trip(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_000, None), (10_001, ""), (10_002, "<|endoftext|>"), (10_003, "z" * 50_000), (10_004, "日本" * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("offset", F.lit("clash")).repartition(3)
    rows = pack(df, gpt_bytes(), block_tokens=20_000).collect()
    exact, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for d, text in docs:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.01 * sum(r["length"] for r in rows)


def test_repeats_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in pack(df, gpt_bytes()).where("start = 0").collect()) == ["1", "1", "None"]
    assert pack(df.limit(0), gpt_bytes()).count() == 0
