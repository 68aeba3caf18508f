"""Reward and policy queries. Completions are stand-ins: an assistant turn whose answer is made
from its length; they exercise the operators and are no model's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import rewards
from lexispark.functions.arrays import stable
from lexispark.session import table
from lexispark.sources import tasks

MAX_NEW = 200
BATCH = 3


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.octet_length("text").cast("bigint")
    answer = F.when(n % 7 == 0, "none").otherwise(F.concat(F.lit("it is "), (n % 5).cast("string"), F.lit(" or -"), (n % 11).cast("string")))
    marked = F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" #### "), (F.col("conv_id") % 9).cast("string"))).otherwise("")
    return df.select("conv_id", "turn", n.alias("n_new"), F.concat(answer, marked).alias("answer"), (F.col("conv_id") % 9).alias("gold"), (n % 3 != 0).alias("terminated"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _completions(spark, sf_dir)
    args = (F.col("terminated"), F.col("n_new"), F.lit(MAX_NEW))
    return df.withColumn("correct", rewards.correctness(F.col("answer"), F.col("gold"))).withColumn("format", rewards.format_score(F.col("answer"), *args)).withColumn("total", rewards.reward(F.col("answer"), F.col("gold"), *args))


def final_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integer that each completion answers with (0 where there is none)."""
    value = rewards.final_int(F.col("answer"))
    return _completions(spark, sf_dir).select("conv_id", "turn", value.isNotNull().alias("found"), F.coalesce(value, F.lit(0)).alias("value"))


def reward_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correctness, format and total reward."""
    df = _scored(spark, sf_dir)
    return df.select("conv_id", "turn", "correct", stable(F.col("format")).alias("format"), stable(F.col("total")).alias("total"))


def group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advantage of each completion in its conversation's group."""
    df = _scored(spark, sf_dir)
    return df.select("conv_id", "turn", stable(rewards.group_advantage(F.col("total"), "conv_id")).alias("advantage"))


def grpo_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped surrogate loss of each group for made-up ratios and masks."""
    df = _scored(spark, sf_dir).withColumn("advantage", rewards.group_advantage(F.col("total"), "conv_id"))
    term = rewards.clipped_surrogate(0.5 + (F.col("n_new") % 100) / F.lit(100.0), F.col("advantage"))
    loss = rewards.masked_loss(term, (F.col("n_new") % 4 != 0).cast("double"))
    return df.groupBy("conv_id").agg(stable(loss).alias("loss"))


def mean_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward of each step (conversations modulo 25)."""
    return _scored(spark, sf_dir).groupBy((F.col("conv_id") % 25).alias("step")).agg(stable(F.avg("total")).alias("reward"), F.count(F.lit(1)).alias("n"))


def reward_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward of the first and of the last ten steps."""
    steps = _scored(spark, sf_dir).groupBy((F.col("conv_id") % 25).alias("step")).agg(F.avg("total").alias("reward"))
    ends = lambda name, order: steps.orderBy(order).limit(10).agg(F.lit(name).alias("span"), stable(F.avg("reward")).alias("reward"))
    return ends("first", F.asc("step")).unionByName(ends("last", F.desc("step")))


def answer_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 questions whose answer, without commas, has an integer."""
    rows = _completions(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("prompt_id"), F.concat(F.lit("Q"), F.col("conv_id").cast("string")).alias("question"), F.when(F.col("n_new") % 7 == 0, "none").otherwise(F.concat(F.lit("so 1,"), F.format_string("%03d", F.col("n_new")))).alias("answer"))
    return tasks.question_bank(rows, key="prompt_id", question="question", answer="answer", max_new=MAX_NEW, limit=40)


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of 20 steps that go round a bank in batches of three (a join on the remainder)."""
    bank = table(spark, sf_dir, "benchmark").select("item_id")
    placed = bank.withColumn("place", F.row_number().over(Window.orderBy("item_id")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    slots = spark.range(20 * BATCH).select(F.expr(f"id div {BATCH}").alias("step"), (F.col("id") % BATCH).alias("slot"), F.col("id").alias("cursor"))
    return slots.join(placed, F.col("cursor") % F.col("n") == F.col("place")).select("step", "slot", "item_id")


QUERIES = {f.__name__: f for f in (final_int, reward_parts, group_advantages, grpo_surrogate, mean_reward, reward_trend, answer_bank, round_robin)}

_C = """n AS (SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS n_new FROM conversations WHERE role = 'assistant'),
    c AS (SELECT conv_id, turn, n_new, CASE WHEN n_new % 7 = 0 THEN 'none' ELSE 'it is ' || (n_new % 5) || ' or -' || (n_new % 11) END
                 || CASE WHEN turn % 4 = 1 THEN ' #### ' || (conv_id % 9) ELSE '' END AS answer, conv_id % 9 AS gold, n_new % 3 <> 0 AS terminated FROM n),
    v AS (SELECT *, TRY_CAST(coalesce(nullif(regexp_extract(answer, '####\\s*(-?\\d+)', 1), ''), regexp_extract_all(answer, '-?\\d+')[-1]) AS BIGINT) AS value FROM c)"""
_S = f"""{_C},
    s AS (SELECT *, CASE WHEN value = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct,
                 ((value IS NOT NULL)::INTEGER + terminated::INTEGER + (n_new > 0 AND n_new <= {MAX_NEW})::INTEGER) / 3.0::DOUBLE AS format FROM v),
    r AS (SELECT *, correct + 0.5::DOUBLE * format AS total FROM s)"""
_A = f"""{_S},
    a AS (SELECT *, CASE WHEN max(total) OVER w = min(total) OVER w THEN 0.0::DOUBLE ELSE (total - avg(total) OVER w) / (stddev_pop(total) OVER w + 1e-6) END AS advantage FROM r WINDOW w AS (PARTITION BY conv_id))"""

ORACLE = {
    "final_int": f"WITH {_C} SELECT conv_id, turn, value IS NOT NULL AS found, coalesce(value, 0) AS value FROM v",
    "reward_parts": f"WITH {_S} SELECT conv_id, turn, correct, round(format, 6) + 0.0 AS format, round(total, 6) + 0.0 AS total FROM r",
    "group_advantages": f"WITH {_A} SELECT conv_id, turn, round(advantage, 6) + 0.0 AS advantage FROM a",
    "grpo_surrogate": f"""WITH {_A},
        t AS (SELECT conv_id, 0.5::DOUBLE + (n_new % 100) / 100.0::DOUBLE AS ratio, advantage, CASE WHEN n_new % 4 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM a)
        SELECT conv_id, round(-sum(least(ratio * advantage, least(greatest(ratio, 0.8::DOUBLE), 1.2::DOUBLE) * advantage) * m) / greatest(1.0::DOUBLE, sum(m)), 6) + 0.0 AS loss FROM t GROUP BY conv_id""",
    "mean_reward": f"WITH {_S} SELECT conv_id % 25 AS step, round(avg(total), 6) + 0.0 AS reward, count(*) AS n FROM r GROUP BY 1",
    "reward_trend": f"""WITH {_S}, m AS (SELECT conv_id % 25 AS step, avg(total) AS reward FROM r GROUP BY 1)
        SELECT 'first' AS span, round(avg(reward), 6) + 0.0 AS reward FROM (SELECT * FROM m ORDER BY step LIMIT 10) f
        UNION ALL SELECT 'last', round(avg(reward), 6) + 0.0 FROM (SELECT * FROM m ORDER BY step DESC LIMIT 10) l""",
    "answer_bank": f"""WITH {_C}
        SELECT conv_id * 100 + turn AS prompt_id, 'Q' || conv_id AS question, 1000 + n_new AS gold, {MAX_NEW} AS max_new FROM c WHERE n_new % 7 <> 0 AND n_new < 1000
        UNION ALL SELECT conv_id * 100 + turn, 'Q' || conv_id, CAST('1' || n_new AS BIGINT), {MAX_NEW} FROM c WHERE n_new % 7 <> 0 AND n_new >= 1000
        ORDER BY prompt_id LIMIT 40""",
    "round_robin": f"""
        WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark)
        SELECT range // {BATCH} AS step, range % {BATCH} AS slot, item_id FROM range({20 * BATCH}) JOIN b ON range % n = place""",
}
