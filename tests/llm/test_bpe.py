import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from kerbline.llm import bpe

RAW = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    out = [None, "", "a", "   \n\n  x", "it's 123 don't\t\t \U0001f600\U0001f600 日本語", "<|endoftext|>", "!" * 3000, "a" * 20_000, "ab" * 9000, "é" * 500]
    out += ["".join(r.choice("abc") for _ in range(5000)), "".join(r.choice("abcdefghtionrs ") for _ in range(20_000))]
    return out + ["".join(r.choice("etaoinsrhl ä\n.,'1") for _ in range(r.randrange(200))) for _ in range(300)]


def test_ids_equal_the_library(reference):
    encoder = bpe.Encoder(RAW, public_tokenizers.PATTERN)
    for x, ids in zip(texts(), encoder.encode(texts())):
        assert ids == reference.encode_ordinary(x or "")
        assert encoder.vocabulary.decode(ids) == (x or "").encode()


def test_a_full_cache_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 8)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    for x, ids in zip(texts(), bpe.Encoder(RAW, public_tokenizers.PATTERN).encode(texts())):
        assert ids == reference.encode_ordinary(x or "")


def test_tables(spark, reference):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df, RAW, public_tokenizers.PATTERN).collect()}
    for i, x in rows:
        ids = reference.encode_ordinary(x or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    encoded = bpe.encode_documents(df, RAW, public_tokenizers.PATTERN, exact="ok")
    assert encoded.columns == ["doc_id", "text", "token_ids", "ok"]
    for r in bpe.decode_documents(encoded, RAW).collect():
        assert r.ok and bytes(r.decoded) == (r.text or "").encode()


def test_a_lower_rank_that_comes_up_goes_first():
    # "bc" merges early, and with "a" it makes a token of lower rank still.
    ranks = [b"abc", b"xy", b"bc", b"cd", b"a", b"b", b"c", b"d", b"x", b"y"]
    raw = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(ranks))
    voc = bpe.Vocabulary(raw)
    own = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=voc.ranks, special_tokens={})
    r = random.Random(0)
    pieces = ["".join(r.choice("abcdxy") for _ in range(r.randrange(1, 12))) for _ in range(500)]
    assert voc.encode([p.encode() for p in pieces]) == [tuple(own.encode_ordinary(p)) for p in pieces]
