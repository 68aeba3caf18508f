"""Packed corpora on disk: Parquet shards by split, a manifest, and raw 16-bit files."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.sources import datasource

MANIFEST = "tokenizer_fingerprint string, vocab_size int, dtype string, add_eos boolean, total_tokens bigint, shards array<struct<name: string, tokens: bigint, split: string>>"


def write_corpus(pieces: DataFrame, shards: DataFrame, manifest: DataFrame, path: str) -> None:
    """pieces (shard, start, tokens) partitioned by split, and the manifest as one JSON line.

    Ids of 16 bits or more fail the write, as 16-bit files could not hold them.
    """
    limit = F.exists("tokens", lambda t: (t < 0) | (t > 65_535))
    checked = pieces.withColumn("tokens", F.when(limit, F.raise_error(F.lit("a token id exceeds 16 bits")).cast("array<int>")).otherwise(F.col("tokens")))
    checked.join(shards.select("shard", "split"), "shard").repartition("split", "shard").sortWithinPartitions("shard", "start").write.mode("overwrite").partitionBy("split").parquet(f"{path}/tokens")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{path}/manifest")


def manifest_from_text(spark: SparkSession, text: str) -> DataFrame:
    """A manifest from JSON text; fields that it does not know fail."""
    record = json.loads(text)
    known = {"tokenizer_fingerprint", "vocab_size", "dtype", "add_eos", "total_tokens", "shards"}
    if set(record) != known:
        raise ValueError(f"manifest fields differ: {sorted(set(record) ^ known)}")
    row = spark.createDataFrame([(text,)], "value string")
    return row.select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")


def shards_for(manifest: DataFrame, split: str) -> DataFrame:
    return manifest.select(F.explode(F.filter("shards", lambda s: s["split"] == split)).alias("s")).select("s.*")


def read_tokens(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(shard, start, tokens, split); order by (shard, start) for the stream. A split prunes files."""
    rows = spark.read.schema("shard bigint, start bigint, tokens array<int>, split string").parquet(f"{path}/tokens")
    return rows if split is None else rows.where(F.col("split") == split)


def matches_tokenizer(manifest: DataFrame, fingerprint: str) -> bool:
    return manifest.select(F.col("tokenizer_fingerprint") == fingerprint).first()[0]


def require_tokenizer(manifest: DataFrame, fingerprint: str, vocab_size: int) -> None:
    """Fail unless a corpus was packed with this tokenizer and fits a model's vocabulary."""
    row = manifest.select("tokenizer_fingerprint", "vocab_size").first()
    if row[0] != fingerprint:
        raise ValueError("the corpus was packed with another tokenizer")
    if row[1] > vocab_size:
        raise ValueError(f"the tokenizer's {row[1]} ids exceed the model's vocabulary of {vocab_size}")


def read_raw_shards(spark: SparkSession, path: str, piece: int = 1 << 20, split: int = datasource.SPLIT) -> DataFrame:
    """(shard, start, tokens) of headerless little-endian 16-bit files shard_NNNNN.bin, in pieces of up to
    ``piece`` tokens; a task reads about ``split`` tokens, by their place in the file.

    In a store that only Spark can open, each file is read whole by one task.
    """
    if datasource.opens(path):
        return datasource.read_ranges(spark, path, piece=piece, split=split)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard_*.bin").load(path).select("path", "content")

    def run(batches):
        import re

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(content, "<u2").astype(np.int32)
                shard = int(re.search(r"shard_(\d+)\.bin$", name)[1])
                starts = list(range(0, len(ids), piece))
                yield pa.RecordBatch.from_pydict({"shard": [shard] * len(starts), "start": starts, "tokens": [ids[s : s + piece] for s in starts]}, schema=pa.schema([("shard", pa.int64()), ("start", pa.int64()), ("tokens", pa.list_(pa.int32()))]))

    return files.mapInArrow(run, "shard bigint, start bigint, tokens array<int>")
