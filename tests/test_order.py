from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexispark.operators import order


def test_prefix_sums_of_any_key(spark):
    rng = random.Random(1)
    keys = [rng.choice([rng.randrange(10), rng.randrange(10**12)]) for _ in range(700)]
    rows = [(k, i, f"k{k}", rng.randrange(9)) for i, k in enumerate(keys)] + [(None, 999, None, 5)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, s string, v int").repartition(5)
    for column in ("k", "s"):
        got = {r.i: r.offset for r in order.with_prefix_sum(df, [column, "i"], F.col("v")).collect()}
        at = 0
        for r in sorted(rows, key=lambda r: (r[0 if column == "k" else 2] is not None, r[0 if column == "k" else 2] or 0 if column == "k" else r[2] or "", r[1])):
            assert got[r[1]] == at
            at += r[3]


def test_row_index_of_nothing_and_one_value(spark):
    df = spark.createDataFrame([], "k bigint")
    assert order.with_row_index(df, ["k"]).count() == 0
    same = spark.range(50).withColumn("k", F.lit(3))
    assert sorted(r.row_index for r in order.with_row_index(same, ["k", "id"]).collect()) == list(range(50))


def test_levels_of_prefix_sums(spark, monkeypatch):
    """Parts of twenty rows, and at most three in the last task: several levels, the same sums."""
    rng = random.Random(2)
    keys = rng.sample(range(10**9), 500)
    rows = [(k, rng.randrange(50), f"x{k}") for k in keys] + [(None, 3, "n")]
    df = spark.createDataFrame(rows, "k bigint, v int, part string").repartition(7)
    seen = []
    deal = order.ordered_parts
    monkeypatch.setattr(order, "ordered_parts", lambda table, by, parts, *rest: (seen.append((table.count(), parts)), deal(table, by, parts, *rest))[1])
    got = {r.k: (r.offset, r.part) for r in order.with_prefix_sum(df, ["k"], F.col("v"), part_rows=20, last_rows=3).collect()}
    assert len(seen) >= 3 and [n for n, _ in seen] == sorted((n for n, _ in seen), reverse=True)
    assert all(parts >= -(-n // 20) for n, parts in seen)
    at = 0
    for k, v, name in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        assert got[k] == (at, name)
        at += v


def test_one_first_value_is_dealt_to_many_parts(spark):
    df = spark.range(3000).withColumn("k", F.lit("same"))
    rows, parts = order.ordered_parts(df, ["k", "id"], 30, [], [], lambda: (lambda batch: [], lambda: []), "test")
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 200 and sum(sizes) == 3000 and parts.count() == len(sizes)
