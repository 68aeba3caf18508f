"""Attention queries: embeddings as tokens of sequences of 16 positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import arrays
from lexispark.functions.schedule import TIERS
from lexispark.operators import attention
from lexispark.session import table

LENGTH = 16
WINDOW = 5
Q_HEADS, KV_HEADS, HEAD_DIM = 4, 2, 16


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, pos, segment (runs of 6 positions), x."""
    df = table(spark, sf_dir, "embeddings")
    pos = (F.col("vec_id") % LENGTH).cast("int")
    return df.select("vec_id", F.expr(f"vec_id div {LENGTH}").alias("seq"), pos.alias("pos"), F.expr(f"CAST(vec_id % {LENGTH} AS INT) div 6").alias("segment"), arrays.doubles("embedding").alias("x"))


def _per_query(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("seq", "i").agg(F.count(F.lit(1)).alias("n_keys"), F.min("j").alias("first_key"))


def attn_pairs_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that each query sees under the causal mask."""
    return _per_query(attention.attention_pairs(_tokens(spark, sf_dir)))


def attn_pairs_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a sliding window: a band join on blocks of positions."""
    return _per_query(attention.attention_pairs(_tokens(spark, sf_dir), window=WINDOW))


def attn_pairs_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within segments: the segment is an equality key."""
    return _per_query(attention.attention_pairs(_tokens(spark, sf_dir), segment="segment"))


def mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed causal mask of 10 positions as pairs, from one expression."""
    one = spark.range(1).select(F.explode(arrays.causal_window(F.lit(10), 3)).alias("p"))
    return one.select("p.i", "p.j")


def gqa_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key/value head of each query head of each tier."""
    rows = [(c.name, h, c.n_q_heads, c.n_kv_heads) for c in TIERS.values() for h in range(c.n_q_heads)]
    heads = spark.createDataFrame(rows, "tier string, q_head int, q int, kv int")
    mapped = None
    for c in TIERS.values():
        part = heads.where(F.col("tier") == c.name).select("tier", "q_head", attention.kv_head(F.col("q_head"), c.n_q_heads, c.n_kv_heads).alias("kv_head"))
        mapped = part if mapped is None else mapped.unionByName(part)
    return mapped


def _qkv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Four query heads over the vector; two key heads in its first half, two value heads in its second."""
    t = _tokens(spark, sf_dir)
    part = lambda h: F.slice("x", h * HEAD_DIM + 1, HEAD_DIM)
    q = t.select("seq", "pos", "segment", F.posexplode(F.array(*[part(h) for h in range(Q_HEADS)])).alias("head", "q"))
    q = q.withColumn("kv_head", attention.kv_head(F.col("head"), Q_HEADS, KV_HEADS))
    kv = t.select("seq", "pos", "segment", F.posexplode(F.array(*[F.struct(part(h).alias("k"), part(h + KV_HEADS).alias("v")) for h in range(KV_HEADS)])).alias("kv_head", "kv"))
    return q, kv.select("seq", "pos", "segment", "kv_head", "kv.k", "kv.v")


def _cells(out: DataFrame) -> DataFrame:
    return out.select("seq", "head", "pos", F.posexplode("out").alias("c", "value")).select("seq", "head", "pos", "c", arrays.stable(F.col("value")).alias("value"))


def attention_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped-query attention with the sliding window, coordinate by coordinate."""
    return _cells(attention.attend(*_qkv(spark, sf_dir), HEAD_DIM, window=WINDOW))


def attention_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-context attention that does not cross segments."""
    return _cells(attention.attend(*_qkv(spark, sf_dir), HEAD_DIM, segment="segment"))


def rope_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and sine of 32 positions for 16-d heads."""
    return attention.rope_table(spark, 32, HEAD_DIM).select("pos", "pair", arrays.stable(F.col("cos")).alias("cos"), arrays.stable(F.col("sin")).alias("sin"))


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix product: all vectors by the first eight as weight rows."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", arrays.doubles("embedding").alias("x"))
    weights = df.where("vec_id < 8").select(F.col("vec_id").alias("o"), F.col("x").alias("w"))
    made = attention.project(df, "x", weights, "y", key=["vec_id"])
    return made.select("vec_id", F.posexplode("y").alias("o", "value")).select("vec_id", "o", arrays.stable(F.col("value")).alias("value"))


def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids (labels of vectors) joined with an embedding table (the labels' mean vector)."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", arrays.doubles("embedding").alias("x"))
    cells = df.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    means = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("e"))
    found = df.select("vec_id", "label").join(means, "label")
    return found.select("vec_id", "label", arrays.stable(arrays.total(F.col("e"))).alias("total"), arrays.stable(F.element_at("e", 1)).alias("head"))


QUERIES = {
    f.__name__: f
    for f in (attn_pairs_causal, attn_pairs_window, attn_pairs_segment, mask_cells, gqa_map, attention_output, attention_segments, rope_table, projection, embedding_lookup)
}

_T = f"""t AS (SELECT vec_id, vec_id // {LENGTH} AS seq, CAST(vec_id % {LENGTH} AS INTEGER) AS pos, (vec_id % {LENGTH}) // 6 AS segment, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
_PAIRS = f"WITH {_T} SELECT q.seq, q.pos AS i, count(*) AS n_keys, min(k.pos) AS first_key FROM t q JOIN t k ON q.seq = k.seq AND k.pos <= q.pos {{}} GROUP BY q.seq, q.pos"
_ATTEND = f"""WITH {_T},
    h AS (SELECT seq, pos, segment, v, CAST(unnest(range({Q_HEADS})) AS INTEGER) AS head FROM t),
    s AS (SELECT q.seq, q.head, q.pos, k.v, q.head // 2 AS kv,
                 list_dot_product(list_slice(q.v, q.head * 16 + 1, q.head * 16 + 16), list_slice(k.v, (q.head // 2) * 16 + 1, (q.head // 2) * 16 + 16)) / 4 AS s
          FROM h q JOIN t k ON q.seq = k.seq AND k.pos <= q.pos {{}}),
    e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, head, pos)) AS e FROM s),
    p AS (SELECT *, e / sum(e) OVER (PARTITION BY seq, head, pos) AS p FROM e),
    c AS (SELECT seq, head, pos, p, kv, v, CAST(unnest(range(16)) AS INTEGER) AS c FROM p)
    SELECT seq, head, pos, c, round(sum(p * v[32 + kv * 16 + c + 1]), 6) + 0.0 AS value FROM c GROUP BY seq, head, pos, c"""

ORACLE = {
    "attn_pairs_causal": _PAIRS.format(""),
    "attn_pairs_window": _PAIRS.format(f"AND q.pos - k.pos < {WINDOW}"),
    "attn_pairs_segment": _PAIRS.format("AND q.segment = k.segment"),
    "mask_cells": "SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j FROM range(10) a JOIN range(10) b ON b.range <= a.range AND a.range - b.range < 3",
    "gqa_map": """
        SELECT tier, CAST(unnest(range(q)) AS INTEGER) AS q_head, CAST(unnest(range(q)) // (q // kv) AS INTEGER) AS kv_head
        FROM (VALUES ('nano', 4, 2), ('mini', 8, 2), ('small', 12, 4)) v(tier, q, kv)""",
    "attention_output": _ATTEND.format(f"AND q.pos - k.pos < {WINDOW}"),
    "attention_segments": _ATTEND.format("AND q.segment = k.segment"),
    "rope_table": """
        SELECT p.range AS pos, CAST(i.range AS INTEGER) AS pair, round(cos(p.range * pow(10000.0::DOUBLE, -2.0::DOUBLE * i.range / 16)), 6) + 0.0 AS cos,
               round(sin(p.range * pow(10000.0::DOUBLE, -2.0::DOUBLE * i.range / 16)), 6) + 0.0 AS sin FROM range(32) p, range(8) i""",
    "projection": f"WITH {_T} SELECT a.vec_id, CAST(w.vec_id AS INTEGER) AS o, round(list_dot_product(a.v, w.v), 6) + 0.0 AS value FROM t a JOIN t w ON w.vec_id < 8",
    "embedding_lookup": """
        WITH x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
        m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY label, i),
        e AS (SELECT label, round(sum(v), 6) + 0.0 AS total, round(sum(CASE WHEN i = 0 THEN v ELSE 0 END), 6) + 0.0 AS head FROM m GROUP BY label)
        SELECT vec_id, label, total, head FROM embeddings JOIN e USING (label)""",
}
