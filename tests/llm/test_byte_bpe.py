from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from lexispark.llm import byte_bpe
from lexispark.llm.queries_text import op8_byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return byte_bpe.ByteBpe(byte_bpe.parse_ranks(byte_bpe.read_vocabulary(RANKS)), P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strings():
    rng = random.Random(5)
    alphabets = ["ab", "abcdefgh ", "aeiou thern", "é中\U0001f600a ́", "\t\n  \x1c\x1d\x1f\x85 x", "'stmrevld 19-=*", "".join(map(chr, range(32, 127)))]
    for alphabet in alphabets:
        for _ in range(120):
            yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
    yield from ["", " ", "a" * 3000, "-" * 2000, " " * 700 + "x", "<|endoftext|>", "İıΣ", "it's we'll THEY'RE"]


def test_equals_the_library(ours, theirs):
    for text in strings():
        ids = theirs.encode_ordinary(text)
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == text.encode()


def test_backtracking_equals_merging_by_rank(ours):
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice("therinagso") for _ in range(rng.randrange(1, 40)))
        assert list(ours.encode_match(text)) == ours.merge_by_rank(text)


def test_cache_overflow_changes_nothing(theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 5)
    small = byte_bpe.ByteBpe(byte_bpe.parse_ranks(byte_bpe.read_vocabulary(RANKS)), P.PATTERN)
    for text in strings():
        assert small.encode(text) == theirs.encode_ordinary(text)


def test_query_on_whole_table(spark, sf_dir, theirs):
    want = {}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = theirs.encode_ordinary(row.text or "")
        want[row.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op8_byte_bpe(spark, sf_dir).collect()}
    assert got == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", "x"), (4, "word " * 5000, None)], "doc_id bigint, text string, ids string")
    rows = byte_bpe.encode_texts(docs, RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.ids)) for r in rows) == [(False, 1, 0), (False, 2, 0), (False, 2, 0), (False, 4, 5001), (True, 0, 2)]
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode_ids(byte_bpe.encode_texts(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    assert back[4] == b"word " * 5000 and back[1] == b""
    assert byte_bpe.encode_texts(docs.limit(0), RANKS, P.PATTERN, digest=True).count() == 0
