"""Document sources: tables, token rows, JSON-lines parts and a synthetic generator."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.functions import rng
from lexispark.operators.order import with_row_index
from lexispark.sources.datasource import Parted, parted_documents

#: Words of synthetic documents, each as often as it is listed.
SYNTHETIC_WORDS = (
    "rivers carry cold water past old stone mills where the miller grinds barley and rye "
    "each morning small boats leave the harbour before rain clouds gather above green hills "
    "children count seven grey geese on a narrow bridge"
).split()
PART_NAME = "part_%05d.jsonl"
PART_PATTERN = r"part_(\d{5,})\.jsonl"


def synthetic_documents(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(doc_id, text): 20 to 120 words of the list, space-joined, with a full stop.

    Each word is a function of (seed, document, place), so documents are made in parallel and
    any range of them can be made again.
    """
    docs = spark.range(n).select(F.col("id").alias("doc_id"), rng.integer(seed, F.col("id"), "length", 20, 120).alias("length"))
    place = lambda i: F.col("doc_id") * 1000 + i
    words = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: rng.pick(seed, place(i), "word", SYNTHETIC_WORDS))
    return docs.select("doc_id", F.concat(F.array_join(words, " "), F.lit(".")).alias("text"))


def raw_documents(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is neither null nor empty."""
    return rows.where(F.col(text) != "")


def token_documents(rows: DataFrame, decode: Callable[[Column], Column], *, tokens: str = "tokens", fallback: str = "input_ids") -> DataFrame:
    """Rows of token lists turned back into text: ``tokens``, else ``input_ids``, where not empty."""
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    have = [c for c in (tokens, fallback) if c in rows.columns]
    ids = F.coalesce(*map(filled, have))
    return rows.withColumn("_ids", ids).where(F.col("_ids").isNotNull()).withColumn("text", decode(F.col("_ids"))).drop("_ids", *have)


SOURCES: dict[str, Callable[..., DataFrame]] = {"synthetic": lambda spark, n=1_000_000, seed=0: synthetic_documents(spark, n, seed)}


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a local copy of a public dataset, Parquet or JSON lines by its name's ending, by an
    explicit schema; only its columns are read."""
    wanted = T._parse_datatype_string(schema)
    if path.rstrip("/").endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")):
        return read_jsonl(spark, path, schema)
    rows = spark.read.parquet(path)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])


def text_source(spark: SparkSession, *, path: str, text: str = "text") -> DataFrame:
    """(text) of a copy of a raw-text dataset; empty and missing texts are left out."""
    return raw_documents(read_rows(spark, path, f"`{text}` string"), text).select(F.col(text).alias("text"))


def token_source(spark: SparkSession, *, path: str, decode: Callable[[Column], Column]) -> DataFrame:
    """(text) of a copy of a pre-tokenised dataset with ``tokens`` or ``input_ids``."""
    return token_documents(read_rows(spark, path, "tokens array<int>, input_ids array<int>"), decode).select("text")


SOURCES |= {"text": text_source, "tokens": token_source}


def register_source(name: str, make: Callable[..., DataFrame]) -> None:
    """Add a named source: a function of (spark, **options)."""
    SOURCES[name] = make


def resolve_source(spark: SparkSession, source: str | Parted | Callable[[], DataFrame | Iterable[str]] | DataFrame | Iterable[str], **options) -> DataFrame:
    """Documents of a source: a registered name, a function, a DataFrame or an iterable of texts; a
    ``Parted`` source is a function that runs in tasks, part by part."""
    if isinstance(source, Parted):
        return parted_documents(spark, source)
    if callable(source):
        source = source()
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        if source not in SOURCES:
            raise ValueError(f"unknown source {source!r}; known: {sorted(SOURCES)}")
        return SOURCES[source](spark, **options)
    return spark.createDataFrame(list(enumerate(source)), "doc_id bigint, text string")


# --- JSON-lines parts --------------------------------------------------------------------


def part_name(index: Column) -> Column:
    return F.format_string(PART_NAME, index)


def part_of(row_index: Column, docs_per_part: int) -> Column:
    """The part a document belongs to: a function of its place alone, so a resumed run gives
    every part the documents it always had."""
    return F.floor(row_index / docs_per_part).cast("bigint")


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def existing_parts(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the parts in a folder, ascending; other names are ignored, no folder is none."""
    import re

    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(folder))
    return sorted(int(m[1]) for name in names if (m := re.fullmatch(PART_PATTERN, name)))


def assign_parts(docs: DataFrame, *, parts: int, docs_per_part: int, have: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """docs plus part, for the first ``parts`` parts that are not in ``have`` (column part)."""
    placed = with_row_index(docs, [order]).withColumn("part", part_of(F.col("row_index"), docs_per_part)).where(F.col("part") < parts)
    return placed if have is None else placed.join(have, "part", "left_anti")


def write_parts(docs: DataFrame, path: str, *, parts: int, docs_per_part: int, overwrite: bool = False, order: str = "doc_id") -> list[str]:
    """Write documents as JSON-lines parts and return the paths of all parts now there.

    Every part is written by one task (its size is fixed by ``docs_per_part``) into a folder of
    its own and renamed into place, so a part is there whole or not at all; existing parts are
    skipped unless overwritten.
    """
    spark = docs.sparkSession
    have = [] if overwrite else existing_parts(spark, path)
    todo = assign_parts(docs, parts=parts, docs_per_part=docs_per_part, order=order, have=spark.createDataFrame([(i,) for i in have], "part bigint") if have else None)
    staged = f"{path.rstrip('/')}/_staged"
    lines = todo.select("part", "row_index", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "row_index").select("part", "value").write.mode("overwrite").partitionBy("part").text(staged)
    folder, fs = _folder(spark, path)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for status in fs.listStatus(path_of(staged)):
        name = status.getPath().getName()
        if name.startswith("part="):
            target = path_of(folder, PART_NAME % int(name.removeprefix("part=")))
            files = [f.getPath() for f in fs.listStatus(status.getPath()) if f.getPath().getName().startswith("part-")]
            if len(files) != 1:
                raise RuntimeError(f"part {name} was written in {len(files)} files")
            if overwrite:
                fs.delete(target, False)
            fs.rename(files[0], target)
    fs.delete(path_of(staged), True)
    return [f"{path.rstrip('/')}/{PART_NAME % i}" for i in existing_parts(spark, path) if i < parts]


def read_parts(spark: SparkSession, path: str, *, first: int = 0, parts: int | None = None) -> DataFrame:
    """(part, line, text) of the parts first, .., first + parts - 1 that exist, in any order:
    (part, line) is the order. Blank lines are skipped; a line without a text fails."""
    wanted = [i for i in existing_parts(spark, path) if i >= first and (parts is None or i < first + parts)]
    if not wanted:
        return spark.createDataFrame([], "part bigint, line bigint, text string")
    files = [f"{path.rstrip('/')}/{PART_NAME % i}" for i in wanted]
    lines = spark.read.text(files, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.where(F.trim("value") != "").select(
        F.regexp_extract("file", PART_PATTERN, 1).cast("bigint").alias("part"), F.struct("block", "at").alias("line"), F.from_json("value", "text string", {"mode": "FAILFAST"})["text"].alias("text")
    )
    checked = parsed.withColumn("text", F.coalesce("text", F.raise_error(F.lit("a line has no text")).cast("string")))
    # within a part, blocks are in file order and ids ascend in a block
    from pyspark.sql import Window

    return checked.withColumn("line", F.row_number().over(Window.partitionBy("part").orderBy("line")).cast("bigint") - 1)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file by an explicit schema; malformed lines fail, blank ones are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)
