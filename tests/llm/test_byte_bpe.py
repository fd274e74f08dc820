import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from plumbline.llm import byte_bpe
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, ids string, units string"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "a", "Word", "\t", ".", "é", "<|endoftext|>", "\U0001f600", "12", " ", "　", "\x1c", "\x85", "'s", "'", "-", "\r\n", "the", " of", "Ünïcödé", "日本語", " ", "²"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 16))) for _ in range(1500)]
    return [*out, "", " ", "w" * 3000, "the quick brown fox " * 2000, "ab" * 400 + " x", " lead", "trail "]


@pytest.mark.parametrize("chars", [0, 500, 1 << 25])
def test_same_ids_as_the_library(spark, ranks, chars):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    rows = texts()
    frame = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(rows)] + [(-1, None, "", "")], SCHEMA)
    encoded = bpe.encode(frame, chars)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    for i, t in enumerate(rows):
        assert got[i] == library.encode_ordinary(t), repr(t[:100])
    assert got[-1] == []
    whole = {r.doc_id: bytes(r.d) for r in encoded.select("doc_id", bpe.decode(F.col("ids")).alias("d")).collect()}
    assert all(whole[i] == t.encode() for i, t in enumerate(rows))
    for r in bpe.digests(bpe.encode(frame, chars)).collect():
        text = rows[r.doc_id] if r.doc_id >= 0 else ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, got[r.doc_id])).encode()).hexdigest()
        assert r.n_tokens == len(got[r.doc_id])


def test_repeated_rows_and_ids(spark, ranks):
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    frame = spark.createDataFrame([(i % 3 if i % 4 else None, "same words, twice  over") for i in range(40)], "doc_id long, text string")
    got = bpe.encode(frame.repartition(5), 60).collect()
    assert len(got) == 40 and len({tuple(r.ids) for r in got}) == 1
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i % 3 if i % 4 else None) for i in range(40))


def test_empty_table(spark, ranks):
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rank_file(ranks):
    line = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").readline().split()
    assert ranks[base64.b64decode(line[0])] == int(line[1])


def test_long_words_in_blocks(spark, ranks):
    import time

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    rng = random.Random(2)
    rows = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("ab", 513), ("etaoinshrdlu", 700), ("aaab", 2000), ("éüß語", 1500), ("abcdefghijklmnopqrstuvwxyz", 5000), ("a", 4000))]
    rows += ["w" * k for k in (511, 512, 513, 514)] + ["the" * 300, "é" * 256, "é" * 257]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(frame).collect()}
    assert all(got[i] == library.encode_ordinary(t) for i, t in enumerate(rows))
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12_000))
    began = time.time()
    assert bpe.encode(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().ids == library.encode_ordinary(long)
    assert time.time() - began < 60
