"""File-stream ingest of JSON-lines parts: new files are packed as they arrive.

The next token offset is the only state: one row per micro-batch beside the stream's checkpoint.
A batch starts where the one before it ended, so replaying a batch gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispark.operators.packing import token_offsets


def stream_parts(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """A stream of (file, block, text) rows of the parts in a folder; blank lines are skipped. ``block`` is where in
    the file the split of a line begins."""
    reader = spark.readStream.format("text").option("pathGlobFilter", "part_*.jsonl")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.where(F.trim("value") != "").select("file", "block", F.from_json("value", "text string")["text"].alias("text"))


def token_totals(stream: DataFrame) -> DataFrame:
    """Running documents and byte-level tokens (with eos) of each part."""
    tokens = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint")
    return stream.groupBy("file").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(tokens).alias("n_tokens"))


def start_packing(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append (batch, file, line, n_tokens, offset) rows to ``out``, ``line`` counting a file's documents: they get consecutive
    token offsets, batch after batch. Each batch overwrites its own folder, so replaying the
    last batch after a failure changes nothing."""

    def place(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = spark.read.schema("next bigint").json(f"{checkpoint}/packing/{number - 1}").first()["next"] if number else 0
        # ids ascend within a split, and splits are in file order: the line's number does not depend on how files are split
        at = batch.select("file", "block", F.monotonically_increasing_id().alias("at"), F.octet_length(F.coalesce("text", F.lit(""))).alias("octets"))
        line = F.row_number().over(Window.partitionBy("file").orderBy("block", "at")).cast("bigint") - 1
        keyed = at.select("file", line.alias("line"), "octets").persist()
        placed = token_offsets(keyed, F.col("octets"), order=["file", "line"])
        rows = placed.select(F.lit(number).cast("bigint").alias("batch_id"), "file", "line", "n_tokens", (F.col("offset") + start).alias("offset"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        total = keyed.agg(F.coalesce(F.sum(F.col("octets") + 1), F.lit(0)).alias("n"))
        total.select((F.col("n") + start).alias("next")).coalesce(1).write.mode("overwrite").json(f"{checkpoint}/packing/{number}")
        keyed.unpersist()

    return stream.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
