"""Validation as joins and set operations; parameter tables of model configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.schedule import ModelConfig, parameter_shapes


def missing_tokens(vocabulary: DataFrame, required: DataFrame, token: str = "token") -> DataFrame:
    """Required tokens that a vocabulary lacks."""
    return required.join(vocabulary, token, "left_anti").select(*required.columns)


def require_tokens(vocabulary: DataFrame, required: DataFrame, token: str = "token") -> DataFrame:
    """The vocabulary; fails if a required token is missing."""
    lacking = missing_tokens(vocabulary, required, token).select(token).limit(5).collect()
    if lacking:
        raise ValueError(f"missing required tokens: {sorted(r[0] for r in lacking)}")
    return vocabulary


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: (key, only_in). Empty for a strict zip."""
    joined = left.select(key, F.lit(True).alias("_l")).join(right.select(key, F.lit(True).alias("_r")), key, "full_outer")
    return joined.where("_l IS NULL OR _r IS NULL").select(key, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("only_in"))


def parameter_table(spark: SparkSession, configs: list[ModelConfig]) -> DataFrame:
    """(tier, tensor, storage, n_dims, numel)."""
    rows = []
    for c in configs:
        for tensor, storage, shape in parameter_shapes(c):
            numel = 1
            for n in shape:
                numel *= n
            rows.append((c.name, tensor, storage, len(shape), numel))
    return spark.createDataFrame(rows, "tier string, tensor string, storage string, n_dims int, numel bigint")


def unique_parameters(rows: DataFrame) -> DataFrame:
    """One row per storage, so that a tied tensor counts once."""
    return rows.groupBy("tier", "storage").agg(F.min("tensor").alias("tensor"), F.first("n_dims").alias("n_dims"), F.first("numel").alias("numel"))


def parameter_group(tensor: Column, n_dims: Column) -> Column:
    """``hidden`` for matrices but the embedding, ``misc`` for the rest."""
    return F.when((n_dims >= 2) & ~F.contains(tensor, F.lit("embed")), "hidden").otherwise("misc")
