"""Sinks and readers: what is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import vocab
from lexispark.operators import packing
from lexispark.operators.order import with_row_index
from lexispark.plans.packing import _SHARDS, CONTEXT, SHARD_TOKENS, VAL_SHARDS
from lexispark.plans.text import PART_SIZE, part_sizes
from lexispark.session import shared_folder, store, table
from lexispark.sources import corpus, datasource, shards

HELD = (3, 7)
RAW_BLOCK = 1024


def parts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON-lines parts written in two runs, the second of which skips what is there."""
    path = shared_folder(spark, "parts")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts, size = part_sizes(docs)
    corpus.write_parts(docs, path, parts=min(HELD[0], parts), docs_per_part=size)
    corpus.write_parts(docs, path, parts=parts, docs_per_part=size)
    return corpus.read_parts(spark, path).select("part", "line", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def part_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the parts in a folder, and whether a range that is read has them."""
    path = shared_folder(spark, "parts")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts, size = part_sizes(docs)
    corpus.write_parts(docs, path, parts=parts, docs_per_part=size)
    read = corpus.read_parts(spark, path, first=HELD[0], parts=HELD[1] - HELD[0]).groupBy("part").agg(F.count(F.lit(1)).alias("lines"))
    there = spark.createDataFrame([(i,) for i in corpus.existing_parts(spark, path)], "part bigint")
    return there.join(read, "part", "left").select("part", F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"))


def _corpus(spark: SparkSession, sf_dir: str) -> str:
    """A packed corpus of all documents on disk."""
    path = shared_folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    placed = packing.token_offsets(docs, F.col("n")).select("doc_id", "n_tokens", "offset")
    listed = packing.pack(placed, SHARD_TOKENS, VAL_SHARDS)
    ids = table(spark, sf_dir, "documents").select("doc_id", vocab.with_specials(vocab.byte_ids(F.col("text")), eos=True).alias("ids"))
    pieces = packing.shard_tokens_table(placed.join(ids, "doc_id"), SHARD_TOKENS)
    shards.write_corpus(pieces, listed, packing.manifest(listed, "fingerprint", 264), path)
    return path


def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a corpus on disk: by the manifest, and what their stored tokens are."""
    path = _corpus(spark, sf_dir)
    named = shards.load_manifest(spark, path)
    listed = shards.shards_for(named, "train").unionByName(shards.shards_for(named, "val"))
    ends = F.size(F.filter("tokens", lambda t: t == 2))
    stored = shards.read_tokens(spark, path).groupBy("shard", "split").agg(F.sum(F.size("tokens")).alias("stored"), F.sum(ends).alias("n_eos"), F.min("start").alias("first"))
    known = listed.select(F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("shard"), "tokens")
    return known.join(stored, "shard").select("shard", "split", "tokens", "stored", "n_eos", "first")


def raw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of headerless 16-bit files: byte lengths of the documents' texts, modulo 2**16. The files are
    written by tasks, and read by ranges of a thousand tokens."""
    path = shared_folder(spark, "raw")
    lengths = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("shard"), "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) % 65_536).cast("int").alias("n"))
    placed = store(with_row_index(lengths, ["shard", "doc_id"]), "lengths")
    first = placed.groupBy("shard").agg(F.min("row_index").alias("first"))
    at = placed.join(F.broadcast(first), "shard").withColumn("at", F.col("row_index") - F.col("first"))  # one row a shard
    blocks = at.groupBy("shard", F.expr(f"at div {RAW_BLOCK} * {RAW_BLOCK}").alias("start")).agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("x"))
    datasource.write_raw_shards(blocks.select("shard", "start", F.transform("x", lambda x: x["n"]).alias("tokens")), path)
    rows = shards.read_raw_shards(spark, path, piece=100, split=1000)
    return rows.groupBy("shard").agg(F.sum(F.size("tokens")).alias("n"), F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t)).alias("total"))


def sampler_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an unbroken sampler, and whether one restarted from its state draws the same."""
    path = _corpus(spark, sf_dir)
    listed = shards.load_manifest(spark, path).select(F.explode("shards").alias("s")).select(F.regexp_extract("s.name", r"(\d+)", 1).cast("bigint").alias("shard"), "s.tokens", "s.split")
    make = lambda: packing.WindowSampler(listed, shards.read_tokens(spark, path, "train").drop("split"), context=CONTEXT, seed=5)
    whole, first, second = make(), make(), make()
    unbroken = whole.next_batch(60).select("draw", F.col("tokens").alias("a"))
    early = first.next_batch(25)
    second.load_state(first.state())
    again = early.unionByName(second.next_batch(35)).select("draw", F.col("tokens").alias("b"))
    return unbroken.join(again, "draw", "left").select("draw", F.size("a").cast("bigint").alias("n"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def raw_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the named sources over a stored copy: raw texts, and token lists decoded."""
    raw = corpus.resolve_source(spark, "text", path=f"{sf_dir.rstrip('/')}/documents.parquet")
    path = shared_folder(spark, "tokens")
    table(spark, sf_dir, "documents").select(vocab.byte_ids(F.col("text")).alias("input_ids")).write.parquet(path)
    decoded = corpus.resolve_source(spark, "tokens", path=path, decode=vocab.byte_text)
    both = raw.select(F.lit("raw").alias("source"), "text").unionByName(decoded.select(F.lit("tokens").alias("source"), "text"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


QUERIES = {f.__name__: f for f in (parts_round_trip, part_range, corpus_round_trip, raw_shards, sampler_restart, raw_source)}

_PARTS = f"""{PART_SIZE}, r AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
    p AS (SELECT i // size AS part, i % size AS line, coalesce(text, '') AS text FROM r, z)"""

ORACLE = {
    "parts_round_trip": f"WITH {_PARTS} SELECT part, line, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM p",
    "part_range": f"WITH {_PARTS} SELECT part, CASE WHEN part >= {HELD[0]} AND part < {HELD[1]} THEN count(*) ELSE 0 END AS lines FROM p GROUP BY part",
    "corpus_round_trip": f"""WITH {_SHARDS},
        e AS (SELECT ("offset" + n_tokens - 1) // {SHARD_TOKENS} AS shard, count(*) AS n_eos FROM placed GROUP BY 1)
        SELECT s.shard, s.split, s.tokens, s.tokens AS stored, coalesce(n_eos, 0) AS n_eos, CAST(0 AS BIGINT) AS first FROM shards s LEFT JOIN e USING (shard)""",
    "raw_shards": "SELECT doc_id % 2 AS shard, count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, ''))) % 65536) AS BIGINT) AS total FROM documents GROUP BY 1",
    "sampler_restart": f"SELECT range AS draw, CAST({CONTEXT} + 1 AS BIGINT) AS n, true AS same FROM range(60)",
    "raw_source": "SELECT s.source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents, (SELECT unnest(['raw', 'tokens']) AS source) s WHERE text IS NOT NULL AND text <> '' GROUP BY s.source",
}
