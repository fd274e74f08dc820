import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from plumbline.llm import rans, token_binary, tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 50_000), 5000).astype(np.uint32)
    slots = rans.frequencies(np.bincount(ids, minlength=1 << 16))
    assert slots.sum() == 1 << rans.BITS
    coder = rans.Coder(slots, lanes=64, block=4096)
    for n in (0, 1, 63, 64, 65, 4096, 4097, 50_000):
        assert (coder.decode(coder.encode(ids[:n])) == ids[:n]).all()
    whole = coder.encode(ids)
    assert (coder.decode(whole, only=3) == ids[3 * 4096 : 4 * 4096]).all()
    broken = bytearray(whole)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(broken))
    with pytest.raises(ValueError):
        coder.decode(b"\0" * 8 + whole[8:])
    one = rans.Coder(rans.frequencies(np.array([0, 7, 0])))
    assert (one.decode(one.encode(np.ones(3000, np.uint32))) == 1).all()


def test_frequencies_with_many_rare_ids():
    counts = np.ones(1 << 16, dtype=np.int64)
    counts[5] = 10**9
    slots = rans.frequencies(counts)
    assert slots.sum() == 1 << rans.BITS and slots.min() >= 1


def test_files(spark, tmp_path):
    texts = ["plain words here", None, "", "é\U0001f600  x\n y", "long " * 5000, "plain words here", "<|endoftext|>"]
    rows = [(9 - i, t, 1, 2) for i, t in enumerate(texts)] + [(9, "tie", 0, 0), (2**60 + 1, "big id", 0, 0), (None, "no id", 0, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, part long, start long")
    path = str(tmp_path / "ids")
    token_binary.write(frame, path, PATH, segment=4096, lanes=16, block=512)
    t = Tokenizer.from_file(PATH)
    want = sorted((-1 if i is None else i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x, _, _ in rows)
    got = sorted(((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids) for r in token_binary.read(spark, path).collect()), key=lambda r: r[0])
    assert sorted((i, ids) for _, i, _, ids in got) == want
    assert [i for _, i, _, _ in got] == sorted(i for i, _ in want)
    at = 0
    for start, _, n, ids in got:
        assert start == at and n == len(ids)
        at += n
    crc = {r.start: r.ids_crc32 for r in token_binary.read_digests(spark, path).collect()}
    assert all(crc[s] == zlib.crc32(np.array(ids, dtype="<u4").tobytes()) for s, _, _, ids in got)


def test_special_strings_are_what_the_library_makes_of_them():
    library = Tokenizer.from_file(PATH)
    rng = random.Random(11)
    parts = ["<|endoftext|>", "a", " ", "word", "  ", "\n", "<|", "endoftext", "|>", "é", "."]
    texts = ["a <|endoftext|> b", "x<|endoftext|>y", "<|endoftext|>", "<|endoftext|><|endoftext|> ", " <|endoftext|>", "no token"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(500)]
    got = tokens.PieceEncoder(PATH).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in np.frombuffer(got[0], "<u2")


def test_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, text string")
    token_binary.write(frame, str(tmp_path / "none"), PATH)
    assert token_binary.read(spark, str(tmp_path / "none")).count() == 0


def test_bounded_cache_gives_the_same_ids():
    texts = [" ".join(f"w{i * j}" for i in range(50)) for j in range(30)]
    small, large = tokens.PieceEncoder(PATH, keep=60), tokens.PieceEncoder(PATH)
    assert [small.encode([t])[0] for t in texts] == large.encode(texts) == large.plain(texts)


def test_pieces_apart_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    parts = ["a", "Word", ".", ",", "\n", "'s", "'", "é", "12", "**", "$", "\t", "x\ny", "y.\nZ!", "日本", "²", ":)", "_", "\r\n", "!!", "<|endoftext|>", " ", "  ", "ª", "e\u0301", "\x1c", "\x85", "\u3000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 20))) for _ in range(4000)]
    encoder = tokens.PieceEncoder(PATH, keep=500)
    for i in range(0, len(texts), 200):
        assert encoder.encode(texts[i : i + 200]) == encoder.plain(texts[i : i + 200])


def test_pieces_that_are_known_are_not_asked_for_again():
    encoder = tokens.PieceEncoder(PATH)
    texts = ["Words met before, and stops (some). été! 12 x\ny  z", "met Words\nété before"]
    again = ["met stops (some). before\nWords,", "été! met  z. 12"]
    want = encoder.plain(again)
    assert encoder.encode(texts) == encoder.plain(texts)
    encoder.encode(["stops Words. Words, Words met 12 été!  z. before\nWords été", "met", "été."])
    encoder.tokenizer = encoder.words = None
    assert encoder.encode(again) == want


def test_cuts_beside_any_white_space_and_sign():
    rng = random.Random(5)
    parts = [*" \t\n\r\x0b\x0c\x1c\x1f\x7f\0\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000\ufeff", "'ll", "'S", "\n\n", "  ", "word", "\xe9t\xe9"]
    parts += [*"aZ0'\".,-_<|\xe9\xd7\xf7\xff\xb5\xaa\xc0\xad\u0100\u0430\u05d0\u0663\u30a2\xb2\u2167\u20ac\u201c\u2026\u0301\u20dd\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(6000)]
    encoder = tokens.PieceEncoder(PATH, keep=700)
    for i in range(0, len(texts), 300):
        assert encoder.encode(texts[i : i + 300]) == encoder.plain(texts[i : i + 300])
    assert max(map(len, encoder.known)) <= 64 and len(encoder.known) == len(encoder.ids) == len(encoder.uses)


def test_long_pieces_are_not_kept_and_kept_ones_are_bounded():
    encoder = tokens.PieceEncoder(PATH, keep=100)
    for i in range(20):
        texts = [f"often {'x' * 70}{i} often", *(f"once{i}q{j}" for j in range(60))]
        assert encoder.encode(texts) == encoder.plain(texts)
        assert len(encoder.known) <= 100 + 66 and not any(len(p) > 64 for p in encoder.known)
    assert "often" in encoder.known and encoder.known[" often"] < len(encoder.ids)
