"""Ids against the tiktoken library, merges against a plain loop."""

import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from lorekeep.llm import bpe, queries

DATA, PATTERN = queries.bpe_vocabulary()
RANKS = bpe.read_ranks(DATA)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(DATA, PATTERN)


@settings(deadline=None, max_examples=300)
@given(st.text())
def test_any_text(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_long_pieces():
    r = random.Random(3)
    for text in ("a" * 20_000, "".join(r.choice("abcde") for _ in range(20_000)), "ab" * 5_000, "é\U0001f600" * 2_000, " " * 5_000):
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_query(spark):
    rows = [(1, "Hello  world's 123\n\n <|endoftext|>", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "über", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for i, text, _ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in bpe.digests(df, DATA, PATTERN).collect())
    assert bpe.digests(df.limit(0), DATA, PATTERN).count() == 0
    coded = bpe.encode(df, DATA, PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded, DATA, PATTERN).collect()}
    assert back[1] == rows[0][1].encode() and back[2] == b""
    assert {r.doc_id: r.ids for r in coded.collect()}[1] == LIBRARY.encode_ordinary(rows[0][1])
