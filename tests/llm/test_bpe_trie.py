"""The trie encoder against the tokenizers library, byte by byte."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerspark.llm import bpe_trie
from ledgerspark.llm.queries import bpe_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe_trie.TrieEncoder(bpe_trie.Vocabulary(open(PATH, "rb").read()))


def ids(packed):
    return np.frombuffer(packed, "<i4").tolist()


ODD = [
    "", " ", "  ", "   a", "a  b", " \n a", "a\n \nb ", "a\t b\r\n", "it's we'll 'x", "x<|endoftext|>y <|endoftext|>", "<|endoftext|",
    "é中́\U0001f600 \x00\x1c\x85\xa0b", "a" * 5000, "ab" * 3000, " " * 999, "１２３ ½ Ⅷ", "don't  stop", " x 　y",
]


def test_odd_texts(encoder, library):
    for text, got in zip(ODD, encoder.encode(ODD)):
        assert ids(got) == library.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_random_texts(encoder, library):
    rng = random.Random(5)
    letters = "aaabbetth  \n\t'sl.,!09é中<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [ids(g) for g in encoder.encode(texts)] == [w.ids for w in want]


def test_every_character(encoder, library):
    texts = [f"a{chr(c)}b {chr(c) * 2} 1{chr(c)} {chr(c)}" for c in [*range(0x3100), 0x1F600, 0x10FFFF]]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [ids(g) for g in encoder.encode(texts)] == [w.ids for w in want]


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_trie, "KEPT_WORDS", 7)
    monkeypatch.setattr(bpe_trie, "KEPT_PAIRS", 5)
    encoder = bpe_trie.TrieEncoder(bpe_trie.Vocabulary(open(PATH, "rb").read()))
    texts = ["some words that share prefixes", "something sometimes some", "words wordless wordsmith and more of them to come"] * 2
    for _ in range(2):
        assert [ids(g) for g in encoder.encode(texts)] == [library.encode(t).ids for t in texts]


def test_tables(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "x", 1), (None, "null id", "x", 1), (99, None, "x", 1), (100, "long " * 200_000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    both = bpe_trie.decode(bpe_trie.encode(docs, PATH), PATH)
    got = both.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in got) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    by_id = {r.doc_id: r.ids for r in got}
    assert by_id[99] == [] and by_id[100] == library.encode("long " * 200_000).ids
    assert bpe_digests(docs.limit(0)).collect() == []


def test_decode_replaces_broken_bytes_and_null_ids(spark, library):
    broken = library.encode("中").ids[:1]
    frame = spark.createDataFrame([(1, broken), (2, None), (3, [50256])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe_trie.decode(frame, PATH).collect()}
    assert got == {1: library.decode(broken, skip_special_tokens=False), 2: "", 3: "<|endoftext|>"}
