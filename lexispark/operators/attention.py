"""Attention as relations: masks as band joins, grouped heads, softmax as window aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.arrays import dot
from lexispark.operators.matmul import blocked_product


def allowed(query_pos: Column, key_pos: Column, window: int | None = None) -> Column:
    """Whether a query may attend to a key: causal, and within the window."""
    causal = key_pos <= query_pos
    return causal if window is None else causal & (query_pos - key_pos < window)


def in_blocks(q: DataFrame, k: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Queries (position i) in their own and the previous block of the window's size, keys
    (position j) in theirs: a pair within the window meets in exactly one block."""
    block = F.expr(f"cast(i as bigint) div {window}")
    met = F.array_distinct(F.array(block, F.greatest(block - 1, F.lit(0).cast("bigint"))))
    return q.withColumn("block", F.explode(met)), k.withColumn("block", F.expr(f"cast(j as bigint) div {window}"))


def attention_pairs(tokens: DataFrame, *, sequence: str = "seq", pos: str = "pos", segment: str | None = None, window: int | None = None) -> DataFrame:
    """(sequence, i, j) of all pairs that may attend.

    The sequence (and segment) are equality keys. With a window, positions are also dealt into
    blocks of the window's size: a query meets only its own and the previous block, so the work
    follows sequence length times window, not its square.
    """
    keys = [sequence] + [segment] * (segment is not None)
    q = tokens.select(*keys, F.col(pos).alias("i"))
    k = tokens.select(*keys, F.col(pos).alias("j"))
    if window is not None:
        q, k, keys = *in_blocks(q, k, window), [*keys, "block"]
    return q.join(k, keys).where(allowed(F.col("i"), F.col("j"), window)).select(sequence, "i", "j")


def kv_head(q_head: Column, n_q_heads: int, n_kv_heads: int) -> Column:
    """The key/value head that a query head shares: the join key, so nothing is repeated."""
    return F.floor(q_head / (n_q_heads // n_kv_heads)).cast("int")


def attend(q: DataFrame, kv: DataFrame, head_dim: int, *, window: int | None = None, segment: str | None = None) -> DataFrame:
    """Softmax attention over rows: q(seq, head, kv_head, pos, q) and kv(seq, kv_head, pos, k, v).

    Returns (seq, head, pos, out array<double>). Scores are normalised by a window over each
    query; outputs are summed per coordinate.
    """
    keys = ["seq", "kv_head"] + [segment] * (segment is not None)
    q, kv = q.withColumnRenamed("pos", "i"), kv.withColumnRenamed("pos", "j")
    if window is not None:
        q, kv, keys = *in_blocks(q, kv, window), [*keys, "block"]
    pairs = q.join(kv, keys).where(allowed(F.col("i"), F.col("j"), window))
    scored = pairs.withColumn("s", dot(F.col("q"), F.col("k")) / F.sqrt(F.lit(float(head_dim))))
    one = Window.partitionBy("seq", "head", "i")
    weighed = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(one)))
    p = weighed.withColumn("p", F.col("e") / F.sum("e").over(one))
    parts = p.select("seq", "head", "i", "p", F.posexplode("v").alias("c", "x"))
    summed = parts.groupBy("seq", "head", "i", "c").agg(F.sum(F.col("p") * F.col("x")).alias("x"))
    rows = summed.groupBy("seq", "head", "i").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("o"))
    return rows.select("seq", "head", F.col("i").alias("pos"), F.transform("o", lambda o: o["x"]).alias("out"))


#: Values of a matrix that is broadcast: 32 MB.
MATRIX_VALUES = 1 << 22


def project(rows: DataFrame, vector: str, weights: DataFrame, out: str, *, key: list[str]) -> DataFrame:
    """rows.vector times a weight matrix given as (o, w array<double>) rows.

    A matrix of at most ``MATRIX_VALUES`` values, which is counted, is gathered into one row that all
    rows get by broadcast, without a shuffle; for a larger one both sides are cut into tiles.
    """
    values, listed, widest = weights.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)), F.count(F.lit(1)), F.max(F.size("w"))).first()
    if not listed:
        return rows.select(*key, F.array().cast("array<double>").alias(out)).limit(0)
    if values <= MATRIX_VALUES:
        matrix = weights.agg(F.array_sort(F.collect_list(F.struct("o", "w"))).alias("_matrix"))
        return rows.join(F.broadcast(matrix)).select(*key, F.transform("_matrix", lambda m: dot(F.col(vector), m["w"])).alias(out))
    return blocked_product(rows, vector, weights, out, key=key, inner=widest, outer=listed)


def rope_table(spark, length: int, head_dim: int, base: float = 10_000.0) -> DataFrame:
    """(pos, pair, cos, sin) for all positions and pairs of coordinates."""
    grid = spark.range(length).withColumnRenamed("id", "pos").withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(head_dim // 2 - 1))))
    angle = F.col("pos") * F.pow(F.lit(base), -2.0 * F.col("pair") / F.lit(head_dim))
    return grid.select("pos", "pair", F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))
