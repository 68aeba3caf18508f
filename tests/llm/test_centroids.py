from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from oracle import canonical, connect

from lexispark.llm import centroids as C

LONG = (1 << 63) - 1


def brute(rows, *, k=16, rounds=3, size=64, scale=64, seed=1):
    """The contract by plain loops over Python integers."""
    kept = [(i, [int(math.floor(scale * x)) if abs(scale * x) < 2**53 else int(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups: dict = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in kept]
    clip = lambda n: min(n, LONG)
    inertia = {j: clip(sum(clip(d) for _, d, l in found if l == j)) for _, _, j in found}
    total = clip(sum(clip(d) for _, d, _ in found))
    return sorted(((i, j, clip(d), inertia[j], total, sha(",".join(map(str, centres[j])))) for i, d, j in found), key=str)


def check(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = C.cluster(table, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, **options)


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    from lexispark.llm.queries_pages import ORACLE, op12_centroids

    got = op12_centroids(spark, sf_dir)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    want = connect(sf_dir).execute(ORACLE["op12_centroids"]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got.toPandas()) == canonical(want)


@pytest.mark.parametrize("large", [1.0, 1e4, 3e5, 1e9, 1e30, 1e300])
def test_sizes_of_components(spark, large):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * (large if i % 7 == 0 else 1) for _ in range(5)]) for i in range(90)]
    check(spark, rows, k=4, size=5)


def test_ties_repeats_and_edges(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-1, 2)) for _ in range(3)]) for i in range(60)] + [(7, [1.0, 1.0, 1.0])] * 40
    rows += [(None, [0.0, 0.0, 1.0]), (None, None), (1, None), (2, [1.0]), (3, [1.0, None, 2.0]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [])]
    for k in (1, 3, 16):
        check(spark, rows, k=k, size=3)
    check(spark, rows[:2], k=16, size=3)
    check(spark, [(1, [-0.01, 0.0, -0.0]), (2, [0.01, 1e-300, -1e-300])], k=2, size=3)
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert C.cluster(empty).count() == 0
    check(spark, [(1, [1.0] * 20_000), (2, [2.0] * 20_000)], k=2, size=20_000)


def test_product_and_integers_agree_at_the_bound():
    rng = np.random.default_rng(4)
    for bits in (20, 22, 23, 26, 40, 52):
        block = np.floor(rng.uniform(-(2.0**bits), 2.0**bits, (50, 8)))
        centres = [[int(e) for e in row] for row in block[:5]]
        centres.append([e + 1 for e in centres[0]])
        label, distance = C.nearest(block, centres)
        exact = [[sum((int(a) - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centres] for x in block]
        assert distance == [min(e) for e in exact] and label.tolist() == [e.index(min(e)) for e in exact]
        sums = {j: s for j, _, s in C.cluster_sums(block, label, 6)}
        assert sums == {int(j): [sum(int(e) for e in col) for col in block[label == j].T] for j in set(label)}


def test_no_task_meets_all_partial_sums(spark):
    # as many parts as tasks, combined in a tree: the same for one task and for many
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = C.whole_vectors(vectors, key="vec_id", vector="embedding", size=4, scale=64)
    first = C.starts(whole, 5, 1)
    assert C.moved(whole.repartition(60), first, 4) == C.moved(whole.coalesce(1), first, 4)
