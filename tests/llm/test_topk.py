from __future__ import annotations

import math

import numpy as np
import pytest

from lexispark.llm import topk


def brute(rows, k, every):
    """rows: (vec_id, list or None); every row is a candidate of every other."""
    ints = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, u) in enumerate(ints):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), c) for m, (c, v) in enumerate(ints) if m != n)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=20, every=20):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return sorted(tuple(r) for r in topk.exact_top_k(table, k, every=every).collect())


@pytest.mark.parametrize("kind", ["normal", "equal norms", "skewed", "ties"])
def test_is_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "EDGES", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12))
    if kind == "equal norms":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "skewed":
        x *= rng.lognormal(0, 2, size=(400, 1)) * np.linspace(3, 0.01, 12)
    if kind == "ties":
        x = rng.integers(-1, 2, size=(400, 12)) / 64
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    assert run(spark, rows) == brute(rows, 20, 20)


def test_exact_products_agree_however_they_are_made(monkeypatch):
    rng = np.random.default_rng(5)
    for size in (100, 1 << 22, 1 << 40):
        q, c = rng.integers(-size, size, (9, 6)), rng.integers(-size, size, (11, 6))
        rows, cols = map(np.ravel, np.indices((9, 11)))
        want = [max(-topk.LONG - 1, min(topk.LONG, sum(int(a) * int(b) for a, b in zip(q[i], c[j], strict=True)))) for i, j in zip(rows, cols, strict=True)]
        for dense in (0.0, 2.0):
            monkeypatch.setattr(topk, "DENSE", dense)
            assert topk.exact_products(q, c, rows, cols).tolist() == want


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf")]), (5, []), (6, [0.5]), (7, [-1.0, 3.0, 9.0]), (20, [0.0, 0.0]), (-20, [2.0, 2.0])]
    assert run(spark, rows) == brute(rows, 20, 20)
    again = [*rows, (7, [-1.0, 3.0, 9.0]), (20, [1.0]), (20, [1.0]), (None, [1.0])]
    assert run(spark, again) == brute(again, 20, 20)
    assert run(spark, [(0, []), (1, []), (20, [])]) == [(0, 1, 1, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]
    assert run(spark, []) == [] == run(spark, [(20, [1.0])])
    huge = [(0, [3e38, -3e38]), (1, [3e38, 3e38]), (2, [1.0, 1.0])]
    assert run(spark, huge) == saturated(huge) == [(0, 1, 2, -64), (0, 2, 1, 1 - (1 << 63))]
    extra = spark.createDataFrame([(20, [1.0], 1, 2, 3, 4, 5), (1, [2.0], 1, 2, 3, 4, 5)], "vec_id bigint, embedding array<float>, row int, id int, norm int, v int, rank int")
    assert [tuple(r) for r in topk.exact_top_k(extra).collect()] == [(20, 1, 1, 64 * 128)]


def saturated(rows):
    """The one query's results with components and scores clamped to 64 bits."""
    clamp = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    ints = [(i, [clamp(math.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]
    q = ints[0][1]
    scored = sorted((-clamp(sum(a * b for a, b in zip(q, v, strict=True))), i) for i, v in ints[1:])
    return [(ints[0][0], n + 1, i, -s) for n, (s, i) in enumerate(scored)]


def test_blocks_of_short_vectors_are_never_met(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(1200, 8))) * np.exp(-np.arange(1200) / 200)[:, None] * 50
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x[rng.permutation(1200)])]
    table, trace = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(2), []
    got = topk.exact_top_k(table, 5, every=20, trace=trace)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 20)
    assert sum(met for met, _ in trace) < 0.4 * sum(whole for _, whole in trace) and trace[-1][0] == 0
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_vectors_are_never_broadcast(spark, monkeypatch):
    # a table of query blocks is small, but not once each block is there for every run of candidates
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 32)
    x = np.random.default_rng(6).normal(size=(6000, 16))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    whole = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1500000b")  # Spark fails if a broadcast is larger
    try:
        got = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", whole)
    ints = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 6000, 20):
        scores = ints @ ints[q]
        order = [c for c in np.lexsort((np.arange(6000), -scores)) if c != q][:20]
        want += [(q, r + 1, int(c), int(scores[c])) for r, c in enumerate(order)]
    assert got == want


def test_cells_of_several_blocks_and_edges_of_several_runs(spark, monkeypatch):
    for name, value in {"BLOCK": 16, "QUERY_BLOCK": 4, "EDGES": 3, "RUNS": 4, "RUN_BLOCKS": 3, "GROUPS": 3, "GROUP_BLOCKS": 2}.items():
        monkeypatch.setattr(topk, name, value)
    x = np.random.default_rng(8).normal(size=(700, 6))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    assert run(spark, rows, 5, 10) == brute(rows, 5, 10)
    for v in (np.zeros((0, 3), np.int64), np.array([[-128, 127]]), np.array([[-129, 0]]), np.array([[0, 32768]]), np.array([[-(1 << 63), topk.LONG]])):
        assert topk.narrow(v).tolist() == v.tolist()


def test_query_on_whole_table(spark, sf_dir):
    from lexispark.llm.queries_pages import op2_topk

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op2_topk(spark, sf_dir).collect()) == brute(rows, 20, 20)
