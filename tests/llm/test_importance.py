from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import connect

from lexispark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, runs=2):
    words = WORD.findall(low(text))
    return words, [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, *, percent=25, min_words=20, runs=2, buckets=10_000):
    """The contract by plain loops; rows of one (score, doc_id) may take each other's place."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, runs)[1]) for texts in ([x for _, x in docs], target))
    S, T = s.total(), t.total()
    rows = []
    for doc_id, text in docs:
        words, found = features(text, runs)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def check(spark, docs, target, **options):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table, goal, **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    options.pop("piece", None)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, **options)


def random_text(rng, n):
    words = ["a", "Ab", "ÉÀ", "naïve", "x1", "日本語", "word", "w" * 80, "\U0001f600", "the", "of"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "--", "\x00", "_", "·"]) for _ in range(n))


def test_whole_query_against_brute_force(spark, sf_dir):
    from lexispark.llm.queries_text import ORACLE, op11_importance

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in op11_importance(spark, sf_dir).collect()), key=str)
    assert got == brute(docs, target)
    assert sorted(connect(sf_dir).execute(ORACLE["op11_importance"]).fetchall(), key=str) == got
    assert sum(r[4] is not None for r in got) > 20


@pytest.mark.parametrize("piece", [1, 7, 200, 1 << 20])
def test_pieces_change_nothing(spark, piece):
    rng = random.Random(3)
    docs = [(i, random_text(rng, rng.randrange(60))) for i in range(80)]
    check(spark, docs, [random_text(rng, 30) for _ in range(5)], piece=piece, min_words=10)


@pytest.mark.parametrize("runs", [1, 3])
def test_other_runs_buckets_and_shares(spark, runs):
    rng = random.Random(4)
    docs = [(i, random_text(rng, rng.randrange(50))) for i in range(60)]
    check(spark, docs, [random_text(rng, 40)], runs=runs, buckets=37, percent=60, min_words=5, piece=50)


def test_edges(spark):
    rng = random.Random(5)
    text = random_text(rng, 40)
    long = (-(1 << 63), "ab cd " * 300_000)
    docs = [(1, None), (2, ""), (3, " .-"), (None, text), (None, random_text(rng, 30)), ((1 << 63) - 1, text), long, (5, text), (5, text), (5, text), (5, text), (6, "one")]
    for percent in (0, 10, 40, 50, 60, 100):
        check(spark, docs, [None, "", text], percent=percent)
    check(spark, docs, [], percent=50)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert importance.resample(empty, empty).count() == 0


def test_kth_key_on_random_keys(spark):
    rng = random.Random(6)
    rows = [(rng.choice([-(1 << 63), -7, 0, 3, 1 << 40, (1 << 63) - 1]), rng.randrange(-4, 4), i) for i in range(300)]
    table = spark.createDataFrame(rows, "x bigint, y bigint, z bigint").cache()
    order = sorted(rows)
    for k in (1, 2, 57, 150, 299, 300):
        assert importance.kth_key(table, k, ["x", "y", "z"]) == order[k - 1]
    assert importance.kth_key(table, 301, ["x", "y", "z"]) is None


def test_repeated_rows_draw_the_exact_number(spark):
    docs = [(1, "same words " * 20)] * 200 + [(2, "other words " * 20)] * 3
    got = importance.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("same",)], "text string"))
    assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 203 * 25 // 100 + 1))


def test_draw_prefers_the_target(spark):
    rng = random.Random(8)
    near, far = [f"near{i}" for i in range(50)], [f"far{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choices(near if i % 10 == 0 else far, k=40))) for i in range(500)]
    goal = [(" ".join(rng.choices(near, k=40)),) for _ in range(50)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(goal, "text string"), percent=10)
    assert np.mean([r.doc_id % 10 == 0 for r in got.where("rank is not null").collect()]) > 0.6
