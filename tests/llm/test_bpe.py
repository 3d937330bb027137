"""Byte-level BPE by a segment tree against the tokenizer library, its short and long forms against each other, and odd rows."""

import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemodex.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n", "a", "  a", "a  b\n\nc ", "don't we'll I'M", "x" * 5000, "é" * 300, "ab" * 40_000, "日本語 テキスト", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "a <|endoftext|> b",
    "​﻿", "🙂🙂 ok", "\r\n\t x", "12345 6.7e8!!", "\x00\x01", "ab " * 30_000, "́a", "   x",
]


@functools.cache
def _library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return _library()


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def one_at_a_time(merges, piece):
    """Merges of a piece by looking through all adjacent pairs each time."""
    symbols = [int(merges.byte_ids[b]) for b in piece]
    while True:
        ranks = [merges.rank_of.get(a * (merges.size + 1) + b, 10**9) for a, b in zip(symbols, symbols[1:])]
        if not ranks or min(ranks) == 10**9:
            return symbols
        at = ranks.index(min(ranks))
        symbols[at : at + 2] = [int(merges.made[ranks[at]])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=8))
def test_any_text(texts):
    library, encoder = _library(), bpe._encoder(PATH)
    for text, got in zip(texts, encoder.encode(texts)):
        assert ids(got) == library.encode(text, add_special_tokens=False).ids
        assert encoder.merges.decode(ids(got)) == text


def test_pieces_by_brute_force(encoder):
    rng, merges = random.Random(3), encoder.merges
    pieces = [bytes(rng.choice(b"aehinrst eo\xc3\xa9") for _ in range(rng.randint(1, 90))) for _ in range(400)]
    for piece, short in zip(pieces, merges.merge_many(pieces)):
        assert ids(short) == one_at_a_time(merges, piece) == ids(merges.merge_long(piece))


def test_leftmost_of_equal_ranks(encoder):
    for n in (2, 3, 4, 5, 9, 17, 33, 65):
        assert ids(encoder.merges.merge_many([b"a" * n])[0]) == one_at_a_time(encoder.merges, b"a" * n) == ids(encoder.merges.merge_long(b"a" * n))


def test_caches_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    encoder = bpe.Encoder(PATH)
    for text in ("the cat sat on the mat", "on a mat sat\nthe other cat", "a  b", "the cat"):
        assert ids(encoder.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "a b c", "x", 1), (3, "\n", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids int")
    out = bpe.encode_documents(docs, PATH)
    assert out.columns == ["doc_id", "_decoded", "_ids", "ids", "decoded"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and got[None].decoded == "a b c"
    for i, text in enumerate(ODD):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].decoded == library.decode(want, skip_special_tokens=False) == (text or "")
    again = bpe.decode_documents(out.select("doc_id", "ids", F.lit(1).alias("decoded")), PATH)
    assert {r.doc_id: r.decoded for r in again.collect()} == {r.doc_id: r.decoded for r in got.values()}
    loose = spark.createDataFrame([(1, None), (2, []), (3, [262, -1, 10**6, None]), (4, [156])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode_documents(loose, PATH).collect()} == {1: None, 2: "", 3: " the", 4: library.decode([156], skip_special_tokens=False)}
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
