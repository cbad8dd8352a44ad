"""BPE trees against the library on random texts, Simple-8b round trips, token files."""

import random
import zlib

import numpy as np
import pytest

from sparseframe.llm import bpe as B
from sparseframe.llm.bpe import Decoder, Encoder, bpe, vocabulary_path
from sparseframe.llm.token_files import dump, load, pack, token_files, unpack

BITS = ["a", "b", "ab", "'s", "'", "!", "?!", "é", "é", "İ", " ", "  ", "\n", "9", "12", "<|endoftext|>", "<|endof", "text|>", "😀", "日本", "ß", "Σ", "the", "ing", "​", "\xa0", "\x1c", "\x01", "#", "###", "$"]


def random_texts(n, seed=3):
    r = random.Random(seed)
    for i in range(n):
        yield "".join(r.choice(BITS) for _ in range(r.randrange(400))) if i % 3 else "".join(r.choice("abctheing'") for _ in range(r.randrange(600)))


@pytest.mark.parametrize(("leaf", "window"), [(40, 8), (7, 4), (150, 16)])
def test_trees_and_words_are_the_library_s(leaf, window):
    enc = Encoder(vocabulary_path(), leaf, window)
    for t in random_texts(400, leaf):
        want = enc.tok.encode(t, add_special_tokens=False).ids
        assert enc.encode_trees([t])[0].tolist() == want
        assert enc.encode([t])[0].tolist() == want
        assert Decoder(enc.tok).text(want) == enc.tok.decode(want, skip_special_tokens=False)


def test_a_batch_of_texts_and_a_small_memo_give_the_same(monkeypatch):
    monkeypatch.setattr(B, "MEMO_WORDS", 60)
    monkeypatch.setattr(B, "MEMO_IDS", 300)
    enc = Encoder(vocabulary_path(), 30, 4)
    texts = [*random_texts(200, 9), "", "  ", "\n", "x" * 500, "É" * 100 + " ×a÷ İx Œuvre, été!!"]
    for k in range(0, len(texts), 40):
        for t, ids in zip(texts[k : k + 40], enc.encode(texts[k : k + 40]), strict=True):
            assert ids.tolist() == enc.tok.encode(t, add_special_tokens=False).ids
        assert len(enc.memo.h1) <= 60 or k == 0


def test_words_with_one_hash_are_told_apart(monkeypatch):
    real = B.hash_spans
    monkeypatch.setattr(B, "hash_spans", lambda data, a, b, which=0: real(data, a, b, which) % np.uint64(7) if not which else real(data, a, b, which))
    enc = Encoder(vocabulary_path(), 40, 8)
    for t in random_texts(60, 4):
        assert enc.encode([t])[0].tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_a_tokenizer_that_keeps_spaces_goes_by_trees():
    enc = Encoder(vocabulary_path("byte_bpe_50k.json"), 64, 8)
    assert not enc.by_word
    for t in random_texts(150):
        want = enc.tok.encode(t, add_special_tokens=False).ids
        assert enc.encode([t])[0].tolist() == want and Decoder(enc.tok).text(want) == enc.tok.decode(want, skip_special_tokens=False)


def test_long_unbroken_text():
    enc = Encoder(vocabulary_path(), 1000)
    for t in ("ab" * 40_000, "a" * 30_001, "x" + "!?" * 9_000):
        assert enc.encode([t])[0].tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_bpe_rows(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (2, "The cat", "x", "y"), (None, "The cat", "x", "y"), (3, "long words " * 3000, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, _text string")
    got = sorted(bpe(df, keep=("doc_id", "_text", "ids")).collect(), key=lambda r: (r["doc_id"] or 0, r["n_tokens"]))
    assert [r["n_tokens"] for r in got] == [2, 0, 0, 2, 6000] and got[0]["decoded"] == "the</w> cat</w>" and got[0]["_text"] == "y"
    assert got[1]["ids"] == [] and got[1]["decoded"] == ""
    assert bpe(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="unknown"):
        bpe(df, outputs=("nothing",))


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        for hi in (2, 50, 50_000, 2**31, 2**59, 2**63):
            x = r.integers(0, hi, n, dtype=np.uint64)
            x[r.random(n) < 0.2] //= np.uint64(1000)
            if hi > 2**60:
                x[r.random(n) < 0.05] = np.uint64(2**64 - 1)
            words, offs = pack(x)
            assert (unpack(words, offs, n) == x).all() and len(offs) == 1 + -(-n // 1024)
    assert len(pack(np.ones(6000, np.uint64))[0]) == 5 * 18 + 15
    names, lengths, ids = load(dump([5, None, -1], [np.arange(3), np.zeros(0), np.arange(2)]))
    assert names.to_pylist() == [5, None, -1] and lengths.tolist() == [3, 0, 2] and ids.tolist() == [0, 1, 2, 0, 1]


def test_token_files(spark):
    r = random.Random(7)
    texts = list(random_texts(60)) + [None, "", "same", "same"]
    ids = [r.randrange(10**6) for _ in texts]
    ids[-1] = ids[-2]
    ids[0] = None
    df = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id long, text string, start string")
    tok = Encoder(vocabulary_path()).tok
    got = token_files(df, outputs=("n_tokens", "ids", "ids_crc32"), segment_ids=500).collect()
    assert len(got) == len(texts)
    at = 0
    for row, (_, _, text) in zip(sorted(got, key=lambda x: x["start"]), sorted((d is not None, d or 0, t or "") for d, t in zip(ids, texts)), strict=True):
        want = [*tok.encode(text, add_special_tokens=False).ids, 2]
        assert row["start"] == at and row["ids"] == want and row["n_tokens"] == len(want)
        assert row["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    assert token_files(df.limit(0)).collect() == []
