"""Raw token files by byte ranges, and documents of injected functions."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.sources import corpus, datasource, shards


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(0)
    want = {3: rng.integers(0, 1 << 16, 10_001), 4: rng.integers(0, 1 << 16, 7), 12345678: np.zeros(0, int)}
    for shard, ids in want.items():
        (tmp_path / f"shard_{shard:05d}.bin").write_bytes(ids.astype("<u2").tobytes())
    (tmp_path / "other.bin").write_bytes(b"x")
    rows = shards.read_raw_shards(spark, str(tmp_path), piece=100, split=1000)
    assert rows.rdd.getNumPartitions() == 12
    found = rows.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in found if r.shard == 3}) == 11
    assert max(sum(len(r.tokens) for r in found if r.task == t) for t in range(12)) == 1000
    for shard, ids in want.items():
        own = sorted((r for r in found if r.shard == shard), key=lambda r: r.start)
        assert [t for r in own for t in r.tokens] == ids.tolist() and [r.start for r in own] == list(range(0, len(ids), 100))
    assert shards.read_raw_shards(spark, "file://" + str(tmp_path), piece=7, split=1).rdd.getNumPartitions() == 1429 + 1
    (tmp_path / "shard_00009.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="odd number of bytes"):
        shards.read_raw_shards(spark, str(tmp_path)).count()


def test_written_files_are_read_back(spark, tmp_path):
    path = f"file:{tmp_path}/raw"
    rows = [(s, at, [(s * 1000 + at + i) % 65536 for i in range(min(50, n - at))]) for s, n in enumerate((120, 50, 333)) for at in range(0, n, 50)]
    pieces = spark.createDataFrame(rows, "shard int, start int, tokens array<int>").repartition(6)
    datasource.write_raw_shards(pieces, path)
    assert sorted(os.listdir(tmp_path / "raw")) == ["shard_00000.bin", "shard_00001.bin", "shard_00002.bin"]
    back = {(r.shard, r.start): r.tokens for r in shards.read_raw_shards(spark, path, piece=50, split=100).collect()}
    assert back == {(s, at): ids for s, at, ids in rows}


@pytest.mark.parametrize("rows", [[(0, 0, [1]), (0, 5, [2])], [(0, 0, [70_000])], [(0, 0, [-1])]])
def test_gaps_and_wide_ids_fail_and_leave_nothing(spark, tmp_path, rows):
    with pytest.raises(Exception, match="token|16 bits"):
        datasource.write_raw_shards(spark.createDataFrame(rows, "shard int, start int, tokens array<int>"), str(tmp_path / "raw"))
    assert [n for n in os.listdir(tmp_path / "raw") if n.startswith("shard")] == []


def test_no_files_and_other_stores(spark, tmp_path):
    assert shards.read_raw_shards(spark, str(tmp_path)).count() == 0
    assert [datasource.opens(p) for p in ("/a", "file:/a", "file:///a", "hdfs://n/a", "viewfs://s/in", "dbfs:/x")] == [True, True, True, True, False, False]


def test_documents_of_a_function(spark):
    source = datasource.Parted(lambda part: (None if i == 1 else f"text {part} {i}" for i in range(part * 1500)), 3)
    docs = corpus.resolve_source(spark, source)
    assert docs.rdd.getNumPartitions() == 3
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == {(p << 32) + i: None if i == 1 else f"text {p} {i}" for p in range(3) for i in range(p * 1500)}
