"""Configuration, schedule, parameter and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import schedule, vocab
from lexispark.functions.arrays import stable
from lexispark.operators import checks
from lexispark.plans import packing as packing_plans
from lexispark.session import table


def tier_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter counts and tokens per step of the presets."""
    step = F.col("micro_batch") * F.col("grad_accum") * F.col("context")
    storages = checks.unique_parameters(checks.parameter_table(spark, list(schedule.TIERS.values())))
    numel = lambda own: F.coalesce(F.sum(F.when(own, F.col("numel"))), F.lit(0)).cast("bigint")
    embed = F.col("storage") == "embed"
    counts = storages.groupBy(F.col("tier").alias("name")).agg(numel(embed).alias("embedding"), numel(~embed).alias("non_embedding"), F.sum("numel").cast("bigint").alias("total"))
    tiers = schedule.tier_table(spark).select("name", step.cast("bigint").alias("tokens_per_step"), "max_steps", "train_tokens")
    return tiers.join(counts, "name").select("name", "embedding", "non_embedding", "total", "tokens_per_step", "max_steps", "train_tokens")


def swiglu_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate width of model widths 64, 128, ..., to the nearest 128 (halves to even)."""
    d = (F.col("id") + 1) * 64
    return spark.range(40).select(d.cast("int").alias("d_model"), (F.bround(8 * d / 3 / 128) * 128).cast("int").alias("hidden"))


def lr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning-rate multiplier of the presets at every 97th step."""
    tiers = schedule.tier_table(spark).select("name", "warmup_steps", "max_steps", "lr_floor_frac")
    steps = tiers.select("*", F.explode(F.expr("sequence(0L, max_steps + 200, 97L)")).alias("step"))
    m = schedule.lr_column(F.col("step"), F.col("warmup_steps"), F.col("max_steps"), F.col("lr_floor_frac"))
    return steps.select("name", "step", stable(m, 9).alias("multiplier"))


def group_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of both parameter groups of the mini preset over its schedule."""
    c = schedule.get_config("mini")
    groups = spark.createDataFrame([("hidden", c.lr_muon), ("misc", c.lr_adamw)], "name string, base double")
    steps = spark.range(0, 41_000, 1000).withColumnRenamed("id", "step")
    m = schedule.lr_column(F.col("step"), *(F.lit(x) for x in (c.warmup_steps, c.max_steps, c.lr_floor_frac)))
    return steps.join(F.broadcast(groups)).select("name", "step", stable(F.col("base") * m, 9).alias("rate"))


def layer_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which layers of the presets see the full context."""
    tiers = schedule.tier_table(spark).select("name", "n_layers", "full_attn_every", "window", "context")
    layers = tiers.select("*", F.explode(F.expr("sequence(0L, n_layers - 1)")).alias("layer"))
    full = (F.col("layer") + 1) % F.col("full_attn_every") == 0
    return layers.select("name", F.col("layer").cast("int").alias("layer"), full.alias("is_full"), F.when(full, F.col("context")).otherwise(F.col("window")).cast("int").alias("span"))


def parameter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors and parameters of each optimizer group of the presets; tied tensors count once."""
    rows = checks.parameter_table(spark, list(schedule.TIERS.values()))
    unique = checks.unique_parameters(rows)
    return unique.groupBy("tier", checks.parameter_group(F.col("tensor"), F.col("n_dims")).alias("group")).agg(F.count(F.lit(1)).alias("n_tensors"), F.sum("numel").cast("bigint").alias("numel"))


def parameter_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors of the nano preset outside both groups, or in both: none of either."""
    rows = checks.unique_parameters(checks.parameter_table(spark, [schedule.TIERS["nano"]]))
    grouped = rows.withColumn("group", checks.parameter_group(F.col("tensor"), F.col("n_dims")))
    parts = [grouped.where(F.col("group") == g).select("tensor") for g in ("hidden", "misc")]
    missing = rows.select("tensor").exceptAll(parts[0].unionByName(parts[1]))
    both = parts[0].intersect(parts[1])
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    return count(rows, "tensors").unionByName(count(missing, "in no group")).unionByName(count(both, "in both groups"))


def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that are in both splits (none), and in all."""
    shards = packing_plans.shard_pack(spark, sf_dir)
    train, val = (shards.where(F.col("split") == s).select("shard") for s in ("train", "val"))
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    return count(train.intersect(val), "both").unionByName(count(train.unionByName(val), "all"))


def missing_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required special tokens that a vocabulary lacks (here the role tokens found in the chats)."""
    have = table(spark, sf_dir, "conversations").select(F.concat(F.lit("<|"), "role", F.lit("|>")).alias("token")).distinct()
    return checks.missing_tokens(have, vocab.special_tokens(spark))


def state_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations zipped strictly on a key: keys that only one side has."""
    left = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("key")).distinct()
    right = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"))
    return checks.unmatched(left, right, "key")


QUERIES = {f.__name__: f for f in (tier_params, swiglu_width, lr_curve, group_rates, layer_schedule, parameter_groups, parameter_partition, split_disjoint, missing_specials, state_zip)}

_TIERS = """tiers(name, d, layers, q, kv, hidden, context, micro, accum, steps, tokens) AS (
    VALUES ('nano', 256, 6, 4, 2, 640, 512, 32, 8, 6000, 200000000), ('mini', 512, 8, 8, 2, 1408, 1024, 16, 32, 40000, 2000000000),
           ('small', 768, 12, 12, 4, 2048, 2048, 8, 64, 60000, 3000000000))"""
_LR = "CASE WHEN step < 300 THEN (step + 1) / 300.0::DOUBLE WHEN step >= {0} THEN 0.1::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * (step - 300) / ({0} - 300))) END"
_TENSORS = f"""WITH {_TIERS},
    l AS (SELECT *, unnest(range(layers)) AS layer FROM tiers),
    p AS (
        SELECT name, 'embed' AS tensor, 'misc' AS g, 32768 * d AS numel FROM tiers
        UNION ALL SELECT name, 'final', 'misc', d FROM tiers
        UNION ALL SELECT name, layer || 'n' || k, 'misc', CASE WHEN k < 2 THEN d ELSE 64 END FROM l, (SELECT unnest([0, 1, 2, 3]) AS k) n
        UNION ALL SELECT name, layer || 'qo' || k, 'hidden', d * q * 64 FROM l, (SELECT unnest([0, 1]) AS k) n
        UNION ALL SELECT name, layer || 'kv' || k, 'hidden', d * kv * 64 FROM l, (SELECT unnest([0, 1]) AS k) n
        UNION ALL SELECT name, layer || 'm' || k, 'hidden', d * hidden FROM l, (SELECT unnest([0, 1, 2]) AS k) n)"""

ORACLE = {
    "tier_params": f"""WITH {_TIERS},
        c AS (SELECT *, CAST(32768 AS BIGINT) * d AS e, CAST(layers AS BIGINT) * (2 * d * (q + kv) * 64 + 128 + 3 * d * hidden + 2 * d) + d AS r FROM tiers)
        SELECT name, e AS embedding, r AS non_embedding, e + r AS total, CAST(micro AS BIGINT) * accum * context AS tokens_per_step, CAST(steps AS BIGINT) AS max_steps, CAST(tokens AS BIGINT) AS train_tokens FROM c""",
    "swiglu_width": "SELECT CAST((range + 1) * 64 AS INTEGER) AS d_model, CAST(round_even(8 * (range + 1) * 64 / 3.0::DOUBLE / 128, 0) * 128 AS INTEGER) AS hidden FROM range(40)",
    "lr_curve": f"WITH {_TIERS}, s AS (SELECT name, steps, unnest(range(0, steps + 201, 97)) AS step FROM tiers) SELECT name, step, round({_LR.format('steps')}, 9) + 0.0 AS multiplier FROM s",
    "group_rates": f"""WITH s AS (SELECT range AS step FROM range(0, 41000, 1000)), g(name, base) AS (VALUES ('hidden', 0.02::DOUBLE), ('misc', 0.003::DOUBLE))
        SELECT name, step, round(base * {_LR.format('40000')}, 9) + 0.0 AS rate FROM s, g""",
    "layer_schedule": f"""WITH {_TIERS}, l AS (SELECT name, context, CAST(unnest(range(layers)) AS INTEGER) AS layer FROM tiers)
        SELECT name, layer, (layer + 1) % 2 = 0 AS is_full, CAST(CASE WHEN (layer + 1) % 2 = 0 THEN context ELSE 256 END AS INTEGER) AS span FROM l""",
    "parameter_groups": f'{_TENSORS} SELECT name AS tier, g AS "group", count(*) AS n_tensors, CAST(sum(numel) AS BIGINT) AS numel FROM p GROUP BY name, g',
    "parameter_partition": f"""{_TENSORS} SELECT 'tensors' AS what, count(*) AS n FROM p WHERE name = 'nano' UNION ALL SELECT 'in no group', 0 UNION ALL SELECT 'in both groups', 0""",
    "split_disjoint": f"WITH {packing_plans._SHARDS} SELECT 'both' AS what, 0 AS n UNION ALL SELECT 'all', count(*) FROM shards",
    "missing_specials": """
        SELECT CAST(id AS INTEGER) AS id, token FROM (VALUES (0, '<|pad|>'), (1, '<|bos|>'), (2, '<|eos|>'), (3, '<|system|>'), (4, '<|user|>'), (5, '<|assistant|>'),
            (6, '<|tool_call|>'), (7, '<|tool_result|>')) v(id, token) WHERE token NOT IN (SELECT '<|' || role || '|>' FROM conversations)""",
    "state_zip": """
        WITH l AS (SELECT DISTINCT s_suppkey % 40 AS key FROM supplier), r AS (SELECT CAST(n_nationkey AS BIGINT) AS key FROM nation)
        SELECT coalesce(l.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'left' ELSE 'right' END AS only_in FROM l FULL JOIN r ON l.key = r.key WHERE l.key IS NULL OR r.key IS NULL""",
}
