"""Byte-level BPE against the tokenizer library and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from prefloom.llm import bpe

SF001 = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.parse_ranks(open(PATH, "rb").read())
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = ["a", "b", "'", "s", "'ll", "'l", "l", " ", "  ", "\n", "\t", "1", "22", "é", "日本", "!", "...", "the", " and", " ", "😀", "-"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, P.PATTERN)


def _random_text(r, n):
    return "".join(r.choice(ALPHABET) for _ in range(n))


@pytest.mark.parametrize("leaf", [1, 2, 3, 5, 17])
def test_tree_equals_library_at_any_leaf_size(codec, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
    monkeypatch.setattr(bpe, "LEAF_BYTES", max(1, leaf))
    monkeypatch.setattr(bpe, "LEAF_IDS", leaf)
    r = random.Random(leaf)
    own = bpe.Codec(RANKS, P.PATTERN)
    for _ in range(300):
        t = _random_text(r, r.randrange(0, 40))
        ids = np.frombuffer(own.encode(t), "<u4")
        assert ids.tolist() == LIB.encode_ordinary(t), repr(t)
        assert own.decode(ids) == t.encode()


def test_white_space_equals_library(codec):
    r = random.Random(4)
    white = [" ", "  ", "\n", " \n", "\n ", "\t \n", "\u00a0", "\u3000 ", "\x1c ", ""]
    for _ in range(20000):
        t = "".join(r.choice(["a", "b's", "c'll", "d1", "é.", "!", "'", "x"]) * r.randrange(2) + r.choice(white) for _ in range(r.randrange(7)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == LIB.encode_ordinary(t), repr(t)


def test_long_matches_and_long_texts(codec):
    r = random.Random(1)
    for t in ["a" * 5000, "ab" * 3000, " " * 40000, "x " * 30000, "".join(r.choice("abcdefgh") for _ in range(20000)), "é" * 9000, "'" * 20000 + "ll"]:
        ids = np.frombuffer(codec.encode(t), "<u4")
        assert codec.decode(ids) == t.encode()
        if len(t) <= 20000 or " " in t:
            assert ids.tolist() == LIB.encode_ordinary(t)


def test_documents(spark):

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    enc = bpe.encode_bpe(docs, PATH, P.PATTERN, keep=["doc_id", "text"])
    rows = bpe.decode_bpe(enc, PATH, P.PATTERN).collect()
    assert len(rows) == docs.count()
    for x in rows:
        assert np.frombuffer(bytes(x.ids), "<u4").tolist() == LIB.encode_ordinary(x.text)
        assert x.n_tokens * 4 == len(x.ids) and bytes(x.decoded) == x.text.encode()


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "hi there <|endoftext|>", None)], "doc_id long, text string, ids2 string")
    a = bpe.encode_bpe(df, PATH, P.PATTERN, as_array=True)
    got = sorted((x.doc_id, x.n_tokens, tuple(x.ids)) for x in a.collect())
    want = LIB.encode_ordinary("hi there <|endoftext|>")
    assert got == [(1, 0, ()), (2, 0, ()), (2, 0, ()), (3, len(want), tuple(want))]
    assert {x.doc_id: bytes(x.decoded) for x in bpe.decode_bpe(a, PATH, P.PATTERN).collect()}[3] == b"hi there <|endoftext|>"
    assert bpe.encode_bpe(df.limit(0), PATH, P.PATTERN).count() == 0
    clash = bpe.encode_bpe(df.withColumnRenamed("ids2", "ids"), PATH, P.PATTERN)
    assert clash.columns == ["doc_id", "text", "n_tokens", "ids"] and clash.count() == 4


def test_query_digests(spark):

    from prefloom.llm.queries import QUERIES

    rows = QUERIES["op3_bpe"](spark, SF001).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    for x in rows[:100]:
        ids = LIB.encode_ordinary(texts[x.doc_id])
        assert x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()


def test_a_merge_looks_up_a_few_pairs_per_byte():
    class Counted(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

    own = bpe.Codec(Counted(RANKS), P.PATTERN)
    for word in (" thonherestinatandedoner", " ereatholyouwhingreth", "inthesreonwh"):
        own.ranks.n = 0
        assert own._merge(word.encode()) == LIB.encode_ordinary(word)
        assert own.ranks.n <= 3 * len(word)


def test_a_frequent_match_outlives_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 4)
    own, done = bpe.Codec(RANKS, P.PATTERN), []
    encode = own.encode_piece
    monkeypatch.setattr(own, "encode_piece", lambda raw: done.append(raw) or encode(raw))
    for i in range(30):
        word = f" rareword{chr(97 + i % 26)}{i // 26 * 'x'}"
        assert np.frombuffer(own.encode(f" hotword{word}"), "<u4").tolist() == LIB.encode_ordinary(f" hotword{word}")
    assert done.count(b" hotword") == 1 and len(own.cache) + len(own.cache.older) <= 10
