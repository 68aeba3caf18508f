from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import bloom_lm as B


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def brute(rows):
    """Exact counts; {row number: (held_out, n_tokens, n_known, N, base, score)}."""
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    uni, bi, n_texts = Counter(), Counter(), 0
    for (_, text), h in zip(rows, held, strict=True):
        if not h:
            own = tokens(text)
            uni.update(own)
            bi.update(zip(["<s>", *own[:-1]], own, strict=True))
            n_texts += 1
    n, v = sum(uni.values()), len(uni)
    level = lambda c: B.ESTIMATES[np.searchsorted(B.LEVELS, c, side="right") - 1] if c else 0.0
    out = []
    for (i, text), h in zip(rows, held, strict=True):
        own, base, score, before = tokens(text), 0.0, 0.0, "<s>"
        for w in own:
            p1 = (uni[w] + 1) / (n + (v + 1))
            left = n_texts if before == "<s>" else uni[before]
            c = min(level(bi[before, w]), left, uni[w])
            base += math.log10(p1)
            score += math.log10((c + B.MU * p1) / (left + B.MU))
            before = w
        out.append((i, h, len(own), sum(uni[w] > 0 for w in own), n, base, score))
    return out


def corpus(n=250):
    rng = random.Random(4)
    words = [f"w{j}" for j in range(40)] + ["É", "é", "x\x85y", "\x1c"]
    texts = [rng.choice([" ", "\n", "  \t"]).join(rng.choice(words[: rng.choice([3, 44])]).upper() for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (None, "w1 w2"), (3, "w1"), (3, "w1")]


def compare(got, want, loose):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    exact = 0
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] <= 0
        exact += g[6] == pytest.approx(w[6], rel=1e-6)
        assert g[6] == pytest.approx(w[6], rel=0.05, abs=1.0)
    assert exact >= loose * len(want)


def test_against_exact_counts(spark, monkeypatch):
    # enough bits that false positives are rare: the filter gives the quantised counts
    monkeypatch.setattr(B, "BITS_PER_TOKEN", 400)
    monkeypatch.setattr(B, "PROBES", 10)
    monkeypatch.setattr(B, "CHUNK_BYTES", 900)
    monkeypatch.setattr(B, "SLICE_TOKENS", 70)
    monkeypatch.setattr(B, "SEGMENT_TOKENS", 500)
    rows = corpus()
    docs = spark.createDataFrame([(*r, True, 1.0) for r in rows], "doc_id bigint, text string, held_out boolean, score double").repartition(3)
    compare([tuple(r) for r in B.score_documents(docs).collect()], brute(rows), 0.99)


def test_production_filter_is_close(spark, sf_dir):
    from lexispark.llm.queries_text import op1_bloom_lm

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got, want = [tuple(r) for r in op1_bloom_lm(spark, sf_dir).collect()], brute(rows)
    compare(got, want, 0.0)
    mean = lambda x: sum(r[6] for r in x) / sum(r[2] for r in x)
    assert mean(got) == pytest.approx(mean(want), rel=0.01)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_filter_levels():
    rng = np.random.default_rng(1)
    short = rng.integers(0, 1 << 32, 4000)
    counts = rng.integers(1, 300, 4000)
    bloom = B.LogBloom(B.enter(short, counts, 1 << 21), 1, 1 << 21)
    want = np.searchsorted(B.LEVELS, counts, side="right")
    got = bloom.levels(short.astype(np.uint64))
    assert (got >= want).all() and (got == want).mean() > 0.99  # no false negatives
    strangers = rng.integers(0, 1 << 32, 20_000).astype(np.uint64)
    assert (bloom.levels(strangers) > 0).mean() < 0.02


def test_overload_still_enters_every_count():
    short, counts = np.arange(1000), np.arange(1000) % 10 + 1
    levels = B.LogBloom(B.enter(short, counts, 8 * 1500), 1, 8 * 1500).levels(short.astype(np.uint64))
    assert (levels >= np.searchsorted(B.LEVELS, counts, side="right")).all()


def test_no_ceiling_drops_rare_bigrams(spark, monkeypatch):
    # a bound on the filter's bits once left bigrams of small counts out; no such bound may act
    monkeypatch.setattr(B, "MAX_BITS", 1 << 13, raising=False)
    monkeypatch.setattr(B, "BITS_PER_TOKEN", 400)
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    compare([tuple(r) for r in B.score_documents(docs).collect()], brute(rows), 0.99)


def test_more_segments_than_bigrams(spark, monkeypatch):
    # a slice sends rows only for segments that it has a bigram in
    monkeypatch.setattr(B, "SEGMENT_TOKENS", 3)
    monkeypatch.setattr(B, "BITS_PER_TOKEN", 400)  # false positives are rare: the filter gives the quantised counts
    monkeypatch.setattr(B, "PROBES", 10)
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(20)}" for _ in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    compare([tuple(r) for r in B.score_documents(docs).collect()], brute(rows), 0.95)
    source = docs.selectExpr("doc_id", "false AS held_out", "text").coalesce(1)
    texts = B.materialize_by_kind(B.read_chunks(source, "doc_id"))(B.TEXTS)
    bigrams = {pair for _, t in rows for pair in zip([None, *t.split()], [*t.split(), None], strict=True)}
    sent = B.count_bigrams(texts, 5000).collect()
    assert texts.count() == 1 and len(sent) <= len(bigrams) < 500
    assert sum(len(B.unpack_sorted(r["keys"])) for r in sent) == len(bigrams)


def test_full_segment_enters_all_counts():
    rng = np.random.default_rng(5)
    short = np.sort(rng.choice(1 << 32, 4000, replace=False))
    counts = rng.integers(0, 6, 4000)
    levels = B.segment_levels(short, counts, 8 * 500)
    assert (levels[counts > 0] >= np.searchsorted(B.LEVELS, counts[counts > 0], side="right")).all()
    assert (levels[counts == 0] > 0).mean() < 0.06


def test_codes():
    x = np.sort(np.random.default_rng(2).integers(0, 1 << 32, 999))
    assert (B.unpack_sorted(B.pack_sorted(x)) == x).all()
    assert len(B.unpack_numbers(B.pack_numbers(np.empty(0)))) == 0
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    s = B.segment_of(keys, 7)
    assert (np.diff(s) >= 0).all() and s.min() == 0 and s.max() == 6
    assert (np.diff(B.ESTIMATES) > 0).all() and B.ESTIMATES[:3].tolist() == [1, 2, 3]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert B.score_documents(empty).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = B.score_documents(spark.createDataFrame([(only_held, "a b")], "doc_id bigint, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    long = B.score_documents(spark.createDataFrame([(0, "a b c " * 60_000)], "doc_id bigint, text string")).first()
    assert long.n_tokens == 180_001
