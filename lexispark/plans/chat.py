"""Chat rendering and packing queries over ``conversations`` (byte-level ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.arrays import stable
from lexispark.operators import chat
from lexispark.plans.text import BYTE_AT, BYTE_ID
from lexispark.session import table

SEQ_LEN = 4096
MICRO_BATCH = 4


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _weighed(c):
    """Sum of value times place (from 1): a checksum that sees the order."""
    return F.aggregate(F.transform(c, lambda t, i: (t * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)


def chat_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-mode token and supervised-token count of each rendered conversation.

    A rendered chat is one bos, then per turn a role header, the content bytes and an eos;
    an assistant's content and eos are supervised. One aggregation shuffle of a row per
    conversation and task.
    """
    octets = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(
            (F.lit(1) + F.sum(octets + 2)).cast("bigint").alias("n_tokens"),
            F.sum(F.when(F.col("role") == "assistant", octets + 1).otherwise(0)).cast("bigint").alias("n_supervised"),
        )
    )


def chat_ids_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered ids and masks: length and checksums of each conversation."""
    rows = chat.render(_turns(spark, sf_dir))
    ids, mask = F.transform("tokens", lambda t: t["id"]), F.transform("tokens", lambda t: t["mask"])
    return rows.select("conv_id", F.size("tokens").cast("bigint").alias("n"), _weighed(ids).alias("ids"), _weighed(mask).alias("mask"))


def generation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts: the conversation and an empty assistant header."""
    rows = chat.render(_turns(spark, sf_dir), generation_prompt=True)
    return rows.select("conv_id", F.size("tokens").cast("bigint").alias("n"), F.element_at("tokens", -1)["id"].alias("last_id"), F.element_at("tokens", -1)["mask"].alias("last_mask"))


def next_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row, start and segment of each conversation under sequential next-fit."""
    lengths = chat_token_counts(spark, sf_dir).select("conv_id", F.col("n_tokens").alias("n"))
    return chat.next_fit(lengths, SEQ_LEN + 1)


def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed, shifted rows: checksums of inputs, targets, mask and segments, and micro-batch."""
    rows = chat.microbatches(chat.pack_conversations(chat.render(_turns(spark, sf_dir)), SEQ_LEN), MICRO_BATCH)
    return rows.select("row", "microbatch", *[_weighed(c).alias(c) for c in ("input_ids", "targets", "loss_mask", "segment_ids")])


def masked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervised and ignored targets of each packed row."""
    rows = chat.pack_conversations(chat.render(_turns(spark, sf_dir)), SEQ_LEN)
    t = chat.masked_targets(F.col("targets"), F.col("loss_mask"))
    count = lambda keep: F.size(F.filter(t, keep)).cast("bigint")
    return rows.select("row", count(lambda x: x != chat.IGNORE_INDEX).alias("supervised"), count(lambda x: x == chat.IGNORE_INDEX).alias("ignored"))


def collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered conversations as completions of a 5-token prompt, padded to the longest."""
    rows = chat.render(_turns(spark, sf_dir)).select("conv_id", F.transform("tokens", lambda t: t["id"]).alias("tokens"), F.lit(5).alias("prompt_len"))
    both = chat.collate(rows)
    return both.select("conv_id", F.size("seq").cast("bigint").alias("n"), _weighed("seq").alias("ids"), F.size(F.filter("comp_mask", lambda m: m)).cast("bigint").alias("n_completion"))


def next_role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which role follows which: the shifted self-join as a window."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = _turns(spark, sf_dir).withColumn("next_role", F.lead("role").over(w)).where("next_role IS NOT NULL")
    return pairs.groupBy("role", "next_role").agg(F.count(F.lit(1)).alias("n"))


def role_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of supervised tokens by role."""
    octets = F.octet_length("text") + 2
    rows = _turns(spark, sf_dir).groupBy("role").agg(F.sum(octets).cast("bigint").alias("tokens"))
    return rows.select("role", "tokens", stable(F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1)))).alias("share"))


QUERIES = {f.__name__: f for f in (chat_token_counts, chat_ids_masks, generation_prompts, next_fit, packed_rows, masked_targets, collated, next_role_pairs, role_share)}

# All tokens of rendered chats, in order: (conv_id, pos, id, mask).
_TOKENS = f"""turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n FROM conversations),
    raw AS (
        SELECT conv_id, turn, role, k, n, CASE WHEN k BETWEEN 1 AND n THEN {BYTE_AT.format(t="text", k="(k - 1)")} ELSE 0 END AS b
        FROM (SELECT *, unnest(range(n + 2)) AS k FROM turns) t),
    ids AS (
        SELECT conv_id, turn, k, CASE WHEN k = 0 THEN CASE role WHEN 'system' THEN 3 WHEN 'user' THEN 4 WHEN 'assistant' THEN 5 WHEN 'tool' THEN 7 END
                                      WHEN k = n + 1 THEN 2 ELSE {BYTE_ID} END AS id,
               CASE WHEN role = 'assistant' AND k > 0 THEN 1 ELSE 0 END AS mask FROM raw
        UNION ALL SELECT DISTINCT conv_id, -1, 0, 1, 0 FROM turns),
    tokens AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS pos, id, mask FROM ids)"""
_COUNTS = """counts AS (
    SELECT conv_id, CAST(1 + sum(octet_length(encode(coalesce(text, ''))) + 2) AS BIGINT) AS n_tokens,
           CAST(sum(CASE WHEN role = 'assistant' THEN octet_length(encode(coalesce(text, ''))) + 1 ELSE 0 END) AS BIGINT) AS n_supervised
    FROM conversations GROUP BY conv_id)"""
_FIT = f"""{_COUNTS},
    o AS (SELECT conv_id, least(n_tokens, {SEQ_LEN + 1}) AS n, row_number() OVER (ORDER BY conv_id) AS i FROM counts),
    fit AS (
        SELECT i, conv_id, n, CAST(0 AS BIGINT) AS "row", CAST(0 AS BIGINT) AS start, 0 AS segment FROM o WHERE i = 1
        UNION ALL
        SELECT o.i, o.conv_id, o.n, CASE WHEN f.start + f.n + o.n > {SEQ_LEN + 1} THEN f."row" + 1 ELSE f."row" END,
               CASE WHEN f.start + f.n + o.n > {SEQ_LEN + 1} THEN 0 ELSE f.start + f.n END, CASE WHEN f.start + f.n + o.n > {SEQ_LEN + 1} THEN 0 ELSE f.segment + 1 END
        FROM fit f JOIN o ON o.i = f.i + 1)"""
_PACKED = f"""WITH RECURSIVE {_FIT}, {_TOKENS},
    placed AS (SELECT "row", start + pos AS p, id, mask, segment FROM fit JOIN tokens USING (conv_id) WHERE pos < fit.n),
    grid AS (SELECT "row", unnest(range({SEQ_LEN + 1})) AS p FROM (SELECT DISTINCT "row" FROM fit) r),
    full_rows AS (SELECT g."row", g.p, coalesce(id, 0) AS id, coalesce(mask, 0) AS mask, coalesce(segment, -1) AS segment FROM grid g LEFT JOIN placed q ON q."row" = g."row" AND q.p = g.p)"""

ORACLE = {
    "chat_token_counts": f"WITH {_COUNTS} SELECT * FROM counts",
    "chat_ids_masks": f"WITH {_TOKENS} SELECT conv_id, count(*) AS n, CAST(sum(id * (pos + 1)) AS BIGINT) AS ids, CAST(sum(mask * (pos + 1)) AS BIGINT) AS mask FROM tokens GROUP BY conv_id",
    "generation_prompts": f"WITH {_COUNTS} SELECT conv_id, n_tokens + 1 AS n, 5 AS last_id, 0 AS last_mask FROM counts",
    "next_fit": f'WITH RECURSIVE {_FIT} SELECT conv_id, CAST(n AS INTEGER) AS n, "row", CAST(start AS INTEGER) AS start, segment FROM fit',
    "packed_rows": f"""{_PACKED}
        SELECT "row", "row" // {MICRO_BATCH} AS microbatch, CAST(sum(CASE WHEN p < {SEQ_LEN} THEN id * (p + 1) ELSE 0 END) AS BIGINT) AS input_ids,
               CAST(sum(id * p) AS BIGINT) AS targets, CAST(sum(mask * p) AS BIGINT) AS loss_mask, CAST(sum(CASE WHEN p < {SEQ_LEN} THEN segment * (p + 1) ELSE 0 END) AS BIGINT) AS segment_ids
        FROM full_rows GROUP BY "row\"""",
    "masked_targets": f"""{_PACKED}
        SELECT "row", CAST(sum(CASE WHEN p > 0 AND mask = 1 THEN 1 ELSE 0 END) AS BIGINT) AS supervised, CAST(sum(CASE WHEN p > 0 AND mask = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ignored
        FROM full_rows GROUP BY "row\"""",
    "collated": f"""WITH {_TOKENS}, m AS (SELECT conv_id, count(*) AS own, CAST(sum(id * (pos + 1)) AS BIGINT) AS ids FROM tokens GROUP BY conv_id)
        SELECT conv_id, max(own) OVER () AS n, ids, greatest(0, own - 5) AS n_completion FROM m""",
    "next_role_pairs": """
        WITH p AS (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations)
        SELECT role, next_role, count(*) AS n FROM p WHERE next_role IS NOT NULL GROUP BY ALL""",
    "role_share": """
        WITH t AS (SELECT role, CAST(sum(octet_length(encode(text)) + 2) AS BIGINT) AS tokens FROM conversations GROUP BY role)
        SELECT role, tokens, round(tokens / sum(tokens) OVER (), 6) + 0.0 AS share FROM t""",
}
