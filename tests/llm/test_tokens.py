import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cairnspark.llm import bpe, token_counts
from cairnspark.llm.common import Memo

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = ["a", "b", "the", "ing", "'s", "'S", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "é", "İ", "ß", "ŉ", "ǅ", "1", "½", "٣", "中", "😀", "<|endoftext|>", "<|startoftext|>", "<|end", "​", "Σ", "ς", "K", "''", "re", "'LL", "...", "!!", "\x00", "_", "ſ"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    mixed = ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]
    return mixed + ["".join(r.choice("etaoinshrdlu'") for _ in range(r.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def test_encoder_equals_library(word):
    enc, dec = bpe.encoder(WORD), bpe.decoder(WORD)
    for t in odd_texts(1500):
        ids = word.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<i4").tolist() == ids
        assert dec.decode(np.array(ids, dtype=int)) == word.decode(ids, skip_special_tokens=False)


def test_byte_level_vocabulary_round_trips():
    enc, lib = bpe.Encoder(BYTE), Tokenizer.from_file(BYTE)
    for t in ["the", "Ġ", "hello", "thereader", "z" * 50]:
        piece = enc.merged(enc.symbols(t.encode()))
        assert piece == lib.encode(t, add_special_tokens=False).ids
        assert bpe.decoder(BYTE).decode(np.array(piece)) == t


def test_long_text_in_blocks(word, monkeypatch):
    monkeypatch.setattr(bpe, "DECODE_BLOCK", 7)
    t = "thation of, the eronth " * 40
    ids = word.encode(t, add_special_tokens=False).ids
    assert bpe.decoder(WORD).decode(np.array(ids)) == word.decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark, word):
    texts = [None, "", "A b", "A b", "x" * 50_000, " \t", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "z", "q") for i, t in enumerate(texts)], "doc_id long, text string, key string, ids string")
    got = {r.doc_id: r for r in bpe.round_trip(df, WORD).collect()}
    for i, t in enumerate(texts):
        ids = word.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, WORD), WORD).collect()
    assert {r.doc_id: r.text for r in back}[2] == "a</w> b</w>"
    assert bpe.round_trip(df.limit(0), WORD).count() == 0


def test_counts_equal_library():
    lib, c = Tokenizer.from_file(BYTE), token_counts.counter(BYTE)
    for t in odd_texts(1500, 2):
        assert c.count(t) == len(lib.encode(t, add_special_tokens=False).ids)


def test_memos_are_bounded_in_bytes(monkeypatch):
    """Long words are not kept at all; of others, no more than the limit."""
    c, e, lib = token_counts.Counter(BYTE), bpe.Encoder(WORD), Tokenizer.from_file(BYTE)
    long = " ".join(f"{i:x}" * 40 + "’" * (i % 2) for i in range(1, 400))
    assert c.count(long) == len(lib.encode(long, add_special_tokens=False).ids)
    e.encode(long)
    assert all(len(k) <= Memo.LONGEST for m in (c.memo, c.unusual, e.pieces, e.memo) for k in m)
    monkeypatch.setattr(Memo, "LIMIT", 3 * Memo.ENTRY)
    c, e = token_counts.Counter(BYTE), bpe.Encoder(WORD)
    for t in odd_texts(50, 3):
        c.count(t), e.encode(t)
    assert max(map(len, (c.memo, c.unusual, e.pieces, e.memo))) <= 3


def test_count_rows(spark):
    lib = Tokenizer.from_file(BYTE)
    texts = [None, "", "A b", "A b", "x y" * 5000, "é"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(df, BYTE).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_counts.token_counts(df.limit(0), BYTE).count() == 0
