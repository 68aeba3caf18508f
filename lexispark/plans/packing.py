"""Shard-packing and window queries over the byte-level tokens of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import vocab
from lexispark.functions.arrays import stable
from lexispark.operators import packing
from lexispark.plans.text import BYTE_AT, BYTE_ID
from lexispark.session import table

SHARD_TOKENS = 50_000
VAL_SHARDS = 2
CONTEXT = 64
DRAWS = 120


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, offset); only lengths are moved, never texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    return packing.token_offsets(docs, F.col("n")).select("doc_id", "n_tokens", "offset")


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_placed(spark, sf_dir), SHARD_TOKENS, VAL_SHARDS)


def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global token offset of each document (exclusive prefix sum in two levels)."""
    return _placed(spark, sf_dir)


def shard_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with their tokens and split."""
    return _shards(spark, sf_dir)


def shard_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of which document lies in which shard."""
    return packing.shard_overlaps(_placed(spark, sf_dir), SHARD_TOKENS)


def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and shards of the manifest by split."""
    record = packing.manifest(_shards(spark, sf_dir), "fingerprint", 264)
    rows = record.select("total_tokens", F.explode("shards").alias("s"))
    return rows.groupBy("total_tokens", F.col("s.split").alias("split")).agg(F.sum("s.tokens").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("n_shards"))


def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start positions of training windows by shard, and their share."""
    return packing.window_starts(_shards(spark, sf_dir), CONTEXT).select("shard", "starts", stable(F.col("probability"), 9).alias("probability"))


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = spark.range(DRAWS).withColumnRenamed("id", "draw")
    u, s = ((F.col("draw") * a + b) % m / F.lit(float(m)) for a, b, m in ((7919, 13, 10007), (104729, 7, 10009)))
    return packing.draw_windows(packing.window_starts(_shards(spark, sf_dir), CONTEXT), draws, u, s).select("draw", "shard", "start")


def window_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that given draws select: shard by weight (interval join), then start."""
    return _draws(spark, sf_dir)


def window_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the drawn windows' inputs and next-token targets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", vocab.with_specials(vocab.byte_ids(F.col("text")), eos=True).alias("ids"))
    placed = _placed(spark, sf_dir).join(docs, "doc_id")
    windows = packing.window_tokens(_draws(spark, sf_dir), packing.shard_tokens_table(placed, SHARD_TOKENS), CONTEXT)
    weighed = lambda c: F.aggregate(F.transform(c, lambda t, i: (t * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    both = packing.inputs_and_targets(windows)
    return both.select("draw", F.size("inputs").cast("bigint").alias("n"), weighed("inputs").alias("inputs"), weighed("targets").alias("targets"))


QUERIES = {f.__name__: f for f in (doc_offsets, shard_pack, shard_overlaps, manifest_totals, window_starts, window_draws, window_slices)}

_PLACED = """placed AS (
    SELECT doc_id, n_tokens, CAST(sum(n_tokens) OVER (ORDER BY doc_id) - n_tokens AS BIGINT) AS "offset"
    FROM (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS n_tokens FROM documents) n)"""
_SHARDS = f"""{_PLACED},
    total AS (SELECT CAST(sum(n_tokens) AS BIGINT) AS total FROM placed),
    s AS (SELECT total, unnest(range((total - 1) // {SHARD_TOKENS} + 1)) AS shard FROM total WHERE total > 0),
    shards AS (
        SELECT shard, 'shard_' || lpad(CAST(shard AS VARCHAR), 5, '0') || '.bin' AS name, CAST(least({SHARD_TOKENS}, total - shard * {SHARD_TOKENS}) AS BIGINT) AS tokens,
               CASE WHEN shard >= max(shard) OVER () + 1 - greatest(0, least({VAL_SHARDS}, max(shard) OVER ())) THEN 'val' ELSE 'train' END AS split FROM s)"""
_STARTS = f"""{_SHARDS},
    st AS (SELECT shard, greatest(0, tokens - {CONTEXT}) AS starts FROM shards WHERE split = 'train'),
    starts AS (SELECT shard, starts, CAST(sum(starts) OVER () AS BIGINT) AS total, CAST(sum(starts) OVER (ORDER BY shard) AS BIGINT) AS high FROM st)"""
_DRAWS = f"""{_STARTS},
    d AS (SELECT range AS draw, (range * 7919 + 13) % 10007 / 10007.0::DOUBLE AS u, (range * 104729 + 7) % 10009 / 10009.0::DOUBLE AS v FROM range({DRAWS})),
    drawn AS (SELECT draw, shard, CAST(floor(v * starts) AS BIGINT) AS start FROM d JOIN starts ON floor(u * total) >= high - starts AND floor(u * total) < high)"""

ORACLE = {
    "doc_offsets": f"WITH {_PLACED} SELECT * FROM placed",
    "shard_pack": f"WITH {_SHARDS} SELECT * FROM shards",
    "shard_overlaps": f"""WITH {_PLACED},
        o AS (SELECT *, unnest(range("offset" // {SHARD_TOKENS}, ("offset" + n_tokens - 1) // {SHARD_TOKENS} + 1)) AS shard FROM placed)
        SELECT doc_id, shard, greatest("offset", shard * {SHARD_TOKENS}) - shard * {SHARD_TOKENS} AS start_in_shard, greatest("offset", shard * {SHARD_TOKENS}) - "offset" AS start_in_doc,
               least("offset" + n_tokens, (shard + 1) * {SHARD_TOKENS}) - greatest("offset", shard * {SHARD_TOKENS}) AS n FROM o""",
    "manifest_totals": f"""WITH {_SHARDS}
        SELECT (SELECT CAST(sum(tokens) AS BIGINT) FROM shards) AS total_tokens, split, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_shards FROM shards GROUP BY split""",
    "window_starts": f"WITH {_STARTS} SELECT shard, starts, round(starts / total, 9) + 0.0 AS probability FROM starts",
    "window_draws": f"WITH {_DRAWS} SELECT * FROM drawn",
    "window_slices": f"""WITH {_DRAWS},
        p AS (SELECT draw, shard * {SHARD_TOKENS} + start + k AS pos, k FROM (SELECT *, unnest(range({CONTEXT} + 1)) AS k FROM drawn) w),
        b AS (SELECT p.draw, p.k, pos - q."offset" = q.n_tokens - 1 AS closes, CASE WHEN pos - q."offset" < q.n_tokens - 1 THEN {BYTE_AT.format(t="t.text", k='(pos - q."offset")')} ELSE 0 END AS b
              FROM p JOIN placed q ON pos >= q."offset" AND pos < q."offset" + q.n_tokens JOIN documents t ON t.doc_id = q.doc_id),
        i AS (SELECT draw, k, CASE WHEN closes THEN 2 ELSE {BYTE_ID} END AS id FROM b)
        SELECT draw, CAST({CONTEXT} AS BIGINT) AS n, CAST(sum(CASE WHEN k < {CONTEXT} THEN id * (k + 1) ELSE 0 END) AS BIGINT) AS inputs,
               CAST(sum(CASE WHEN k > 0 THEN id * k ELSE 0 END) AS BIGINT) AS targets FROM i GROUP BY draw""",
}
