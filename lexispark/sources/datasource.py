"""Data sources of Spark's Python interface: raw 16-bit token files, and documents of a function.

A raw file is cut into byte ranges when a read is planned, from the files' sizes alone; each range is
a task that seeks to its place, so no file is read whole and a large one is read by many tasks. Files are
written in tasks too, each under a temporary name, and take their names when all tasks have ended; a lost
task leaves nothing that is read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RAW_SCHEMA = "shard bigint, start bigint, tokens array<int>"
_RAW_ARROW = pa.schema([("shard", pa.int64()), ("start", pa.int64()), ("tokens", pa.list_(pa.int32()))])
RAW_NAME = re.compile(r"shard_(\d+)\.bin$")
#: Tokens of a row, and of a task.
PIECE = 1 << 20
SPLIT = 1 << 24
#: Schemes whose files tasks can open by themselves; others are read by Spark's own reader.
SCHEMES = ("", "file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def opens(path: str) -> bool:
    """Whether tasks can open ``path``."""
    return (path.split("://")[0] if "://" in path else path.partition(":/")[0] if ":/" in path else "") in SCHEMES


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path).rstrip("/"))


@dataclass
class TokenRange(InputPartition):
    path: str
    shard: int
    first: int
    count: int


class RawReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.piece = options["path"], int(options.get("piece", PIECE))
        self.split = max(1, int(options.get("split", SPLIT)) // self.piece) * self.piece

    def partitions(self) -> list[TokenRange]:
        files, folder = _located(self.path)
        found = []
        for info in sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
            if (named := RAW_NAME.search(info.path)) and info.is_file:
                if info.size % 2:
                    raise ValueError(f"{info.path} has an odd number of bytes")
                n = info.size // 2
                found += [TokenRange(info.path, int(named[1]), at, min(self.split, n - at)) for at in range(0, n, self.split)]
        return found or [TokenRange("", 0, 0, 0)]

    def read(self, partition: TokenRange) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        files, _ = _located(self.path)
        with files.open_input_file(partition.path) as stream:
            stream.seek(2 * partition.first)
            for at in range(0, partition.count, self.piece):
                ids = np.frombuffer(stream.read(2 * min(self.piece, partition.count - at)), "<u2").astype(np.int32)
                yield pa.RecordBatch.from_pydict({"shard": [partition.shard], "start": [partition.first + at], "tokens": [ids]}, schema=_RAW_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class RawWriter(DataSourceArrowWriter):
    """Each shard comes to one task, in order of ``start``."""

    def __init__(self, options):
        self.path, self.run = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _located(self.path)
        context = TaskContext.get()
        own = f"{folder}/_temporary-{self.run}/{context.partitionId()}-{context.taskAttemptId()}"
        files.create_dir(own, recursive=True)
        done: list[tuple[int, str]] = []
        stream, current, n = None, None, 0
        try:
            for batch in iterator:
                for shard, start, tokens in zip(*(batch.column(i) for i in range(3)), strict=True):
                    if shard.as_py() != current:
                        if stream:
                            stream.close()
                        current, n = shard.as_py(), 0
                        done.append((current, f"{own}/{current}.bin"))
                        stream = files.open_output_stream(done[-1][1])
                    ids = tokens.values.to_numpy(zero_copy_only=False)
                    if start.as_py() != n or (len(ids) and not 0 <= ids.min() <= ids.max() < 1 << 16):
                        raise ValueError(f"shard {current}: token {n} is missing, or an id exceeds 16 bits")
                    stream.write(ids.astype("<u2").tobytes())
                    n += len(ids)
        finally:
            if stream:
                stream.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _located(self.path)
        done = [f for m in messages if m for f in m.files]
        if len({shard for shard, _ in done}) < len(done):
            raise ValueError("a shard came to several tasks")
        for shard, name in done:
            files.move(name, f"{folder}/shard_{shard:05d}.bin")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _located(self.path)
        left = f"{folder}/_temporary-{self.run}"
        if files.get_file_info(left).type != fs.FileType.NotFound:
            files.delete_dir(left)


class RawShards(DataSource):
    """``spark.read.format("raw_shards").load(path)``; options ``piece`` and ``split`` count tokens."""

    @classmethod
    def name(cls) -> str:
        return "raw_shards"

    def schema(self) -> str:
        return RAW_SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options)


def read_ranges(spark: SparkSession, path: str, *, piece: int = PIECE, split: int = SPLIT) -> DataFrame:
    """(shard, start, tokens) of the files shard_NNNNN.bin in a folder that tasks can open."""
    spark.dataSource.register(RawShards)
    return spark.read.format(RawShards.name()).option("piece", piece).option("split", split).load(path)


def write_raw_shards(pieces: DataFrame, path: str) -> None:
    """Write pieces (shard, start, tokens) as files shard_NNNNN.bin of little-endian 16-bit ids. Pieces of a
    shard follow each other without gaps; a shard is one file, so one task streams it."""
    pieces.sparkSession.dataSource.register(RawShards)
    ordered = pieces.selectExpr("CAST(shard AS bigint) AS shard", "CAST(start AS bigint) AS start", "CAST(tokens AS array<int>) AS tokens").repartition("shard").sortWithinPartitions("shard", "start")
    ordered.write.format(RawShards.name()).mode("append").save(path)


# --- documents of a function -------------------------------------------------------------


@dataclass(frozen=True)
class Parted:
    """A document source: ``make(part)`` gives the texts of one of ``parts`` parts."""

    make: Callable[[int], Iterable[str | None]]
    parts: int


@dataclass
class PartNumber(InputPartition):
    number: int


#: Texts of a batch.
BATCH = 1024


def parted_documents(spark: SparkSession, source: Parted) -> DataFrame:
    """(doc_id, text): the function runs in tasks, one for each part; a doc_id is the part's number
    times 2**32 plus the text's place."""
    kind = f"documents_{uuid.uuid4().hex}"

    class Reader(DataSourceReader):
        def partitions(self) -> list[PartNumber]:
            return [PartNumber(i) for i in range(source.parts)]

        def read(self, partition: PartNumber) -> Iterator[pa.RecordBatch]:
            first = partition.number << 32
            for texts in batched(source.make(partition.number), BATCH):
                yield pa.RecordBatch.from_pydict({"doc_id": range(first, first + len(texts)), "text": texts}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
                first += len(texts)

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return "doc_id bigint, text string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Documents)
    return spark.read.format(kind).load()
