from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from lexispark.llm import exact_dedup


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    keep, size = {}, {}
    for doc_id, text in rows:
        n = low(text)
        keep[n] = max((x for x in (keep.get(n), doc_id) if x is not None), default=None)
        size[n] = size.get(n, 0) + 1
    return sorted(((i, keep[low(t)], size[low(t)], i == keep[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows), key=str)


def check(spark, rows, capacity):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(docs, capacity=capacity).collect()), key=str)
    assert got == brute(rows)


def test_against_brute_force_at_several_capacities(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "Aa", "aA", "É", "é", "x" * 9, "word " * 400, f"text {rng.randrange(60)}"])) for i in range(600)]
    for capacity in (1, 7, 10_000):
        check(spark, rows, capacity)


def test_edges(spark):
    check(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None)], 2)
    empty = spark.createDataFrame([], "doc_id bigint, text string, kept string, h int")
    assert exact_dedup.exact_groups(empty).count() == 0
    clash = spark.createDataFrame([(1, "A", "q", 3), (2, "a", "r", 4)], "doc_id bigint, text string, kept string, h int")
    assert exact_dedup.keep_rows(clash).collect() == [(2, "a", "r", 4)]


def test_keep_rows_leaves_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "A"), (1, "a"), (None, "n"), (None, "n"), (3, None), (2, "")], "doc_id bigint, text string")
    kept = sorted((str(r.doc_id), (r.text or "").lower()) for r in exact_dedup.keep_rows(docs).collect())
    assert kept == [("1", "a"), ("3", ""), ("None", "n")]


def colliding(spark):
    """Five hashes for thirty texts, most of them with several copies."""
    rng = random.Random(7)
    rows = [(i, f"text {rng.randrange(30)}") for i in range(200)] + [(None, "text 1"), (5, "text 5")]
    keyed = spark.createDataFrame([(i, t, (int(t[5:]) % 5 - 2) << 61) for i, t in rows], "key bigint, norm string, h bigint")
    return rows, keyed


def test_equal_hashes_are_chained_and_compared_by_bytes(spark):
    rows, keyed = colliding(spark)
    got = sorted((tuple(r) for r in exact_dedup.groups_of(keyed, capacity=1).collect()), key=str)
    assert got == brute(rows)
    index = exact_dedup.Index(keyed, capacity=1)
    assert all(r.links == len(r.texts) == 6 for r in index.chains.collect())
    entries = index.entries(index.placed()).collect()
    assert sorted((r.h, r.chain) for r in entries) == sorted((c << 61, p) for c in (-2, -1, 0, 1, 2) for p in range(1, 7))


def test_rows_are_found_through_the_directory(spark):
    # the directory leads to the entries: with another one nothing is found
    _, keyed = colliding(spark)
    index = exact_dedup.Index(keyed, capacity=2)
    placed = index.placed()
    entries = index.entries(placed).select("slot", "h", "chain", "group_size")
    assert placed.join(entries, ["slot", "h", "chain"]).count() == 202
    index.cells = index.cells.withColumn("slot", F.col("slot") + 1)
    assert index.placed().join(entries, ["slot", "h", "chain"]).count() == 0


def test_large_directory_is_joined(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_CELLS", 4)
    check(spark, [(i, f"text {i % 90}") for i in range(300)], 3)


def test_directory_splits_only_overfull_buckets(spark):
    # 40 hashes under one long prefix, 3 elsewhere: the latter keep a shallow bucket
    hashes = [(i << 45,) for i in range(40)] + [(-1,), (-(1 << 62),), (1 << 62,)]
    entries = spark.createDataFrame(hashes, "h bigint")
    cells, depth = exact_dedup.directory(entries, capacity=20)
    depths = {r.cell: r.local_depth for r in cells.collect()}
    assert depth >= 4 and depths[0] == depth and max(v for k, v in depths.items() if k >> depth - 4) < depth
    size: dict = {}
    for (h,) in hashes:
        at = h >> 64 - depth & (1 << depth) - 1
        row = next(r for r in cells.collect() if r.cell == at) if at in depths else None
        size[row.slot] = size.get(row.slot, 0) + 1
    assert max(size.values()) <= 20 and len(size) >= 4
    assert exact_dedup.directory(entries, capacity=43)[1] == 0


def test_keep_rows_carries_any_column(spark):
    schema = "doc_id bigint, text string, _key string, _sha int, _KEY_ int, h int, slot int, cell int, chain int, key int, norm string"
    docs = spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, 5, 6, 7, "n") for i, t in [(1, "a"), (2, "A"), (3, "b")]], schema)
    assert sorted(tuple(r)[:3] for r in exact_dedup.keep_rows(docs).collect()) == [(2, "A", "k"), (3, "b", "k")]
    assert exact_dedup.keep_rows(docs).columns == docs.columns and exact_dedup.exact_groups(docs).count() == 3


def test_very_long_text(spark):
    check(spark, [(1, "Ab " * 700_000), (2, "aB " * 700_000), (3, "ab " * 700_000 + "c")], 1)
