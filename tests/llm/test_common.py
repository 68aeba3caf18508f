from __future__ import annotations

import os
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import common


def test_folds_are_crc32_of_the_text(spark):
    ids = [0, 1, -5, 10**12, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    for r in df.select("doc_id", common.fold("doc_id", 7).alias("f")).collect():
        assert r.f == zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7


def test_only_ascii_capitals_are_lowered(spark):
    df = spark.createDataFrame([("AzÉİΣ",), (None,)], "t string")
    assert [r[0] for r in df.select(common.ascii_lower(F.col("t"))).collect()] == ["azÉİΣ", ""]


def test_materialize_and_drop(spark):
    made = common.materialize(spark.range(10), "test")
    folder = os.path.dirname(made.inputFiles()[0].removeprefix("file://"))
    assert made.count() == 10 and os.path.isdir(folder)
    assert folder.startswith(common.shared_dir(spark).removeprefix("file://"))
    common.drop_materialized(made)
    assert not os.path.exists(folder)


def test_shared_folder_is_the_sessions(spark, tmp_path):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: f"file://{tmp_path}/" if key == "spark.checkpoint.dir" else default)

    assert common.shared_dir(Session) == f"file://{tmp_path}"


def test_a_cluster_without_a_shared_folder_fails():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session)


def test_maps_keep_order_and_pass_empty_tables(spark):
    df = spark.range(3000).repartition(2).withColumn("t", F.col("id").cast("string"))

    def make():
        return lambda rows: {"id": rows["id"], "n": [len(t) for t in rows["t"]]}

    out = common.map_rows(df, "id bigint, n int", make)
    assert {r.id: r.n for r in out.collect()} == {i: len(str(i)) for i in range(3000)}
    assert common.map_rows(df.limit(0), "id bigint, n int", make).count() == 0
    kept = common.filter_rows(df, "t", lambda: lambda values: [v.endswith("7") for v in values])
    assert kept.columns == df.columns and sorted(r.id for r in kept.collect()) == list(range(7, 3000, 10))


def test_batch_setting_is_bounded_but_not_raised(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 300)
    common.bound_batches(spark)
    assert spark.conf.get(key) == "300"
    spark.conf.set(key, 10_000)
    common.bound_batches(spark)
    assert spark.conf.get(key) == str(common.BATCH_ROWS)


def test_worker_cache_belongs_to_one_operator():
    with common.worker_task("a"):
        common.WORKER_CACHE["x"] = 1
    with common.worker_task("a"):
        assert common.WORKER_CACHE == {"x": 1}
    with common.worker_task("b"):
        assert common.WORKER_CACHE == {}


def test_slices():
    batch = pa.RecordBatch.from_pydict({"a": list(range(1300))})
    assert [b.num_rows for b in common.slices([batch])] == [512, 512, 276]
