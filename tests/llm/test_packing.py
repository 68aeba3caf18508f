from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tokenizers

from lexispark.llm import packing
from lexispark.llm.byte_bpe import read_vocabulary

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(FILE)


def texts():
    rng = random.Random(3)
    for alphabet in ["abc d", "It's we'll x9 ", "éñÜß…œ ab", "\t\n\x1c\x85\xa0 ab!?", "ΣİıſŁ中 a", "".join(map(chr, range(33, 0x180)))]:
        for _ in range(60):
            yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 50)))
    yield from ["", None, "x" * 5000, "'s'd''re!'", "<|endoftext|> a", "a<|endoftext|>b", "A <|ENDOFTEXT|> b", "x<|startoftext|> y<|endoftext|><|endoftext|>", "word " * 9000]


def test_ids_equal_the_library(library, monkeypatch):
    for cache in (10, 400_000):
        monkeypatch.setattr(packing, "CACHE_WORDS", cache)
        monkeypatch.setattr(packing, "CHUNK_CHARS", 500)
        ours = packing.WordTokenizer(read_vocabulary(FILE))
        cases = list(texts())
        for text, got in zip(cases, ours.encode_batch(cases), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def check_layout(rows, want, capacity, library):
    """want: (doc_id, text) of all input rows. Returns (ids, pads)."""
    encoded = defaultdict(list)
    for doc_id, text in want:
        encoded[doc_id].append(library.encode(text or "", add_special_tokens=False).ids + [2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == encoded.keys()
    for doc_id, pieces in by_doc.items():
        if len(encoded[doc_id]) > 1:
            assert sum(p.length for p in pieces) == sum(map(len, encoded[doc_id]))
            continue
        ids, at = encoded[doc_id][0], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    total = pads = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
        pads += packing.padding(at, capacity)
    return total, pads


def test_query_on_whole_table(spark, sf_dir, library):
    from lexispark.llm.queries_text import op6_harmonic_packing

    rows = op6_harmonic_packing(spark, sf_dir).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    total, pads = check_layout(rows, docs, 4096, library)
    assert pads < 0.03 * total


def test_edges_and_small_capacity(spark, library):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b " * 700, 9), (None, "x y", 9), (5, "same", 9), (5, "same", 9)], "doc_id bigint, text string, length int")
    rows = packing.pack_documents(docs, read_vocabulary(FILE), capacity=64).collect()
    check_layout(rows, [(r.doc_id, r.text) for r in docs.collect()], 64, library)
    assert packing.pack_documents(docs.limit(0), read_vocabulary(FILE)).count() == 0


def test_cut_and_first_fit():
    for n in range(1, 9000, 7):
        pieces = packing.cut(n)
        assert sum(pieces) == n and len(pieces) <= n // 4096 + 6
    placed = packing.first_fit_decreasing([5, 5, 5, 3, 2], 10)
    assert placed == [(0, 0), (0, 5), (1, 0), (1, 5), (1, 8)]


def test_ids_on_request(spark, library):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    rows = sorted(packing.pack_documents(docs, read_vocabulary(FILE), with_ids=True).collect(), key=lambda r: r.start)
    assert [i for r in rows for i in r.ids] == library.encode("some words here", add_special_tokens=False).ids + [2]
