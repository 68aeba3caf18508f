"""Shared helpers: tables, shared-folder materialisation, Arrow maps and learning folds."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests, a laptop in local mode) a temporary folder is made
    and set; a cluster always names one, so no machine-local folder is used there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lexispark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back.

    Cuts lineage; a lost executor costs only the tasks it was running, as the files are in
    the shared folder and each task commits its file whole.
    """
    path = "/".join([shared_dir(df.sparkSession), "lexispark", *_scratch, f"{label}-{uuid.uuid4().hex}"])
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders, inside one another, of the ``scratch`` blocks that are open.
_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[None]:
    """Tables materialised inside are removed at the end; what is to stay is written with
    ``materialize_outside`` before."""
    _scratch.append(f"{label}-{uuid.uuid4().hex}")
    path = "/".join([shared_dir(spark), "lexispark", *_scratch])
    try:
        yield
    finally:
        _scratch.pop()
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize_outside(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` into the folder around the innermost ``scratch`` block."""
    inner = _scratch.pop()
    try:
        return materialize(df, label)
    finally:
        _scratch.append(inner)


def drop_materialized(df: DataFrame) -> None:
    """Remove the files of a table made by ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(conf).delete(folder, True)


#: A key with at least one row in so many is joined by broadcast; there are at most so many of them.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with one row per key of ``facts``, whose column ``size`` says how many
    rows have the key. Both are stored tables. Keys with a thousandth of all rows or more - so at
    most a thousand keys - are broadcast and their rows stay where they are; the others are dealt out.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_KEYS >= total
    few = F.broadcast(facts.where(hot))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(facts.where(hot).select(*keys)), keys, "left_anti").join(facts.where(~hot), keys))


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, or a longer one where a table has a column of that name (in any case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: Column | str, n: int) -> Column:
    """crc32 of the key's decimal text modulo ``n``: the folds that contracts speak of."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def map_rows(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Apply a batch function to Arrow batches of ``df``.

    ``make`` runs once a task and returns a function from columns (lists) to columns (lists);
    the two may differ in length.
    """
    bound_batches(df.sparkSession)
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_task(make.__qualname__):
            step = make()
            for batch in slices(batches):
                with collector_off():
                    out = step({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def filter_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """Rows of ``df`` whose value of ``column`` is kept; a narrow map that keeps all columns.

    ``make`` runs once a task and returns a function from values to decisions.
    """
    bound_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_task(make.__qualname__):
            keep = make()
            for batch in slices(batches):
                with collector_off():
                    kept = keep(batch.column(at).to_pylist())
                yield batch.filter(pa.array(kept, type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: Rows that Python holds as objects at a time, and rows of an Arrow batch.
SLICE_ROWS = 512
BATCH_ROWS = 1024
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What a Python worker keeps from one task of an operator to the next, and whose it is.
WORKER_CACHE: dict = {}
_owner: list[str] = [""]


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows, which are made for numbers: with
    texts they take tens of megabytes in the JVM and again in Python. A session's own setting
    below that default is left alone."""
    if int(spark.conf.get(_BATCH_SETTING, "10000")) >= 10_000:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


@contextmanager
def worker_task(name: str) -> Iterator[None]:
    """A task of an operator in a Python worker, which Spark uses again for other tasks.

    What another operator left in the worker is dropped, and memory that the task has freed is
    given back to the system at its end.
    """
    if _owner[0] != name:
        WORKER_CACHE.clear()
        _owner[0] = name
    try:
        yield
    finally:
        release_memory()


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # where the C library has it
    except (OSError, AttributeError):
        pass


@contextmanager
def collector_off() -> Iterator[None]:
    """No cyclic garbage collection in a batch: its lists and caches hold no cycles, and walking
    them again and again costs a tenth of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _arrow_schema(struct: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def partitions_for(spark: SparkSession, n_bytes: int, per_partition: int) -> int:
    """Partition count from a measured size, at least the session's shuffle partitions."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(base, -(-int(n_bytes) // per_partition), 1)


def letters(text: str) -> bool:
    """Whether a text has at least one letter."""
    return any(map(str.isalpha, text))
