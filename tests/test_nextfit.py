"""Next-fit by composed transitions is the sequential loop."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import chat, nextfit


def loop(sizes, capacity, state=nextfit.START):
    fill, row, items = state
    out = []
    for n in sizes:
        if fill + n > capacity:
            fill, row, items = 0, row + 1, 0
        out.append((row, fill, items))
        fill, items = fill + n, items + 1
    return out, (fill, row, items)


def random_sizes(rng, capacity, n):
    kind = rng.randrange(4)
    low, high = [(0, capacity), (0, max(1, capacity // 10)), (capacity // 2, capacity), (0, 1)][kind]
    return np.array([rng.randint(low, high) for _ in range(n)], dtype=np.int64)


def test_functions_of_stretches():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([1, 2, 7, 30])
        stretches = [random_sizes(rng, capacity, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 5))]
        total = None
        for s in stretches:
            own = nextfit.steps_of(s, capacity)
            total = own if total is None else nextfit.composed(total, own, capacity)
        assert len(total) <= capacity + 1 and total[0, nextfit.LOW] == 0
        for fill in range(capacity + 1):
            state = (fill, 5, 3)
            assert nextfit.applied(total, state) == loop(np.concatenate(stretches), capacity, state)[1]
            rows, starts, segments, end = nextfit.placed(stretches[0], state, capacity)
            want, after = loop(stretches[0], capacity, state)
            assert list(zip(rows.tolist(), starts.tolist(), segments.tolist(), strict=True)) == want and end == after


def test_composition_is_associative():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([3, 12, 50])
        a, b, c = (nextfit.steps_of(random_sizes(rng, capacity, rng.randrange(1, 30)), capacity) for _ in range(3))
        left = nextfit.composed(nextfit.composed(a, b, capacity), c, capacity)
        right = nextfit.composed(a, nextfit.composed(b, c, capacity), capacity)
        for state in ((f, 0, 1) for f in range(capacity + 1)):
            assert nextfit.applied(left, state) == nextfit.applied(right, state)


@pytest.mark.parametrize("sizes", [{}, {"part_rows": 40, "last_rows": 8, "fan_in": 3}])
def test_table_is_the_loop(spark, sizes):
    rng = random.Random(3)
    for capacity in (9, 60):
        rows = [(k, rng.randint(0, capacity + 5)) for k in rng.sample(range(10**6), 900)]
        table = spark.createDataFrame(rows, "conv_id bigint, n int").repartition(6)
        got = [tuple(r) for r in chat.next_fit(table, capacity, **sizes).orderBy("conv_id").collect()]
        cut = [(k, min(n, capacity)) for k, n in sorted(rows)]
        want, _ = loop([n for _, n in cut], capacity)
        assert got == [(k, n, *place) for (k, n), place in zip(cut, want, strict=True)]


def test_no_task_reads_all_lengths(spark):
    table = spark.range(4000).select(F.col("id").alias("conv_id"), (F.col("id") % 50 + 1).cast("int").alias("n"))
    placed = chat.next_fit(table, 100, part_rows=100, last_rows=20)
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1000 and sum(sizes) == 4000


def test_nothing_and_one(spark):
    table = spark.createDataFrame([(None, 4)], "conv_id bigint, n int")
    assert chat.next_fit(table.limit(0), 10).count() == 0
    assert [tuple(r) for r in chat.next_fit(table, 3).collect()] == [(None, 3, 0, 0, 0)]
