"""Blocked matrix products equal the broadcast ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import attention, matmul


def tables(spark, n, d, o, seed=0):
    rng = np.random.default_rng(seed)
    x, w = rng.normal(size=(n, d)), rng.normal(size=(o, d))
    rows = spark.createDataFrame([(i, f"k{i}", v.tolist()) for i, v in enumerate(x)], "i bigint, k string, v array<double>").repartition(3)
    weights = spark.createDataFrame([(10 * j, v.tolist()) for j, v in enumerate(w)], "o bigint, w array<double>").repartition(2)
    return x @ w.T, rows, weights


@pytest.mark.parametrize(("n", "d", "o", "tile"), [(30, 7, 5, 4), (30, 7, 5, 1), (50, 64, 40, 256), (9, 1, 1, 8), (40, 3, 100, 60)])
def test_equals_the_product(spark, monkeypatch, n, d, o, tile):
    monkeypatch.setattr(matmul, "INNER", 5)
    monkeypatch.setattr(matmul, "BLOCKS", 2)
    want, rows, weights = tables(spark, n, d, o)
    got = matmul.blocked_product(rows, "v", weights, "y", key=["i", "k"], inner=d, outer=o, tile=tile)
    assert got.columns == ["i", "k", "y"]
    found = {r.i: (r.k, r.y) for r in got.collect()}
    assert len(found) == n and all(found[i][0] == f"k{i}" and np.allclose(found[i][1], want[i]) for i in range(n))


def test_large_matrices_take_it(spark, monkeypatch):
    want, rows, weights = tables(spark, 12, 6, 8)
    small = {r.i: r.y for r in attention.project(rows, "v", weights, "y", key=["i"]).collect()}
    monkeypatch.setattr(attention, "MATRIX_VALUES", 47)
    large = attention.project(rows, "v", weights, "y", key=["i"])
    assert "NestedLoop" not in large._jdf.queryExecution().executedPlan().toString()
    found = {r.i: r.y for r in large.collect()}
    assert found.keys() == small.keys() and all(np.allclose(found[i], small[i]) and np.allclose(found[i], want[i]) for i in found)
    assert attention.project(rows, "v", weights.limit(0), "y", key=["i"]).count() == 0
    assert attention.project(rows.limit(0), "v", weights, "y", key=["i"]).count() == 0


def test_null_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(attention, "MATRIX_VALUES", 1)
    _, rows, weights = tables(spark, 3, 4, 2)
    missing = rows.withColumn("v", F.when(F.col("i") > 0, F.col("v")))
    found = {r.i: r.y for r in attention.project(missing, "v", weights, "y", key=["i"]).collect()}
    assert found[0] == [None, None] and len(found) == 3 and None not in found[1]
    with pytest.raises(Exception, match="not of length 4"):
        attention.project(rows.withColumn("v", F.slice("v", 1, 3)), "v", weights, "y", key=["i"]).collect()


def test_tiles_are_bounded():
    for inner, outer in ((4096, 65_536), (100_000, 10), (7, 5), (1, 1_000_000), (65_536, 65_536)):
        t = matmul.Tiling(inner, outer)
        assert t.inner_size * t.outer_size <= matmul.TILE and t.rows * max(t.inner_size, t.outer_size) <= max(matmul.TILE, t.inner_size, t.outer_size)
        assert t.outer_size * inner <= max(matmul.STRIP, inner) and t.rows * outer <= max(matmul.STRIP, outer)
        assert [b - a for a, b in t.ranges()][:-1] == [t.inner_size] * (len(t.ranges()) - 1) and t.ranges()[-1][1] == inner
