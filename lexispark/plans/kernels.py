"""Array-kernel queries: each 64-d embedding is a row of activations or logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import arrays
from lexispark.operators import scoring
from lexispark.session import table

TOP_K = 8
TILE = 7


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", arrays.doubles("embedding").alias("x"))


def _long(df: DataFrame, values: Column, name: str = "value") -> DataFrame:
    """(vec_id, i, value): one row per coordinate, rounded."""
    return df.select("vec_id", F.posexplode(values).alias("i", name)).select("vec_id", "i", arrays.stable(F.col(name)).alias(name))


def _weight(x: Column) -> Column:
    """A gain vector: 1 + i / 64."""
    return F.transform(x, lambda v, i: F.lit(1.0) + i / F.lit(64.0))


def rmsnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return _long(df, arrays.rmsnorm(F.col("x"), _weight(F.col("x"))))


def rmsnorm_dx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input gradient of RMSNorm; the output gradient is the vector reversed."""
    df = _vectors(spark, sf_dir)
    return _long(df, arrays.rmsnorm_dx(F.col("x"), F.reverse("x"), _weight(F.col("x"))))


def rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation by position vec_id mod 128."""
    return _long(_vectors(spark, sf_dir), arrays.rope(F.col("x"), F.col("vec_id") % 128))


def rope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse rotation (its backward pass) returns the vector."""
    turned = _vectors(spark, sf_dir).withColumn("y", arrays.rope(F.col("x"), F.col("vec_id") % 128))
    return _long(turned, arrays.rope(F.col("y"), F.col("vec_id") % 128, inverse=True))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"))


def swiglu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_halves(spark, sf_dir), arrays.swiglu(F.col("a"), F.col("b")))


def swiglu_grads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients of the gate's two inputs for an output gradient of a reversed."""
    df = _halves(spark, sf_dir)
    dy = F.reverse("a")
    both = df.select("vec_id", F.posexplode(F.arrays_zip(arrays.swiglu_grad_a(F.col("a"), F.col("b"), dy).alias("da"), arrays.swiglu_grad_b(F.col("a"), dy).alias("db"))).alias("i", "g"))
    return both.select("vec_id", "i", arrays.stable(F.col("g.da")).alias("da"), arrays.stable(F.col("g.db")).alias("db"))


def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax at temperature 0.5."""
    return _long(_vectors(spark, sf_dir), arrays.softmax(F.col("x"), 0.5))


def logsumexp_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-sum-exp merged from tiles of 7 logits, and in one piece."""
    df = _vectors(spark, sf_dir)
    cells = df.select("vec_id", F.posexplode("x").alias("i", "logit"))
    tiled = scoring.tiled_logsumexp(cells, ["vec_id"], F.expr(f"i div {TILE}"))
    whole = df.select("vec_id", arrays.logsumexp(F.col("x")).alias("whole"))
    return tiled.join(whole, "vec_id").select("vec_id", arrays.stable(F.col("lse")).alias("lse"), arrays.stable(F.col("whole")).alias("whole"))


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy rows: the target is vec_id mod 64, every fifth is ignored."""
    target = F.when(F.col("vec_id") % 5 == 0, F.lit(-100)).otherwise((F.col("vec_id") % 64).cast("int"))
    df = _vectors(spark, sf_dir).withColumn("target", target)
    return df.withColumn("nll", arrays.logsumexp(F.col("x")) - F.get("x", F.greatest(F.col("target"), F.lit(0))))


def masked_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cross-entropy over supervised targets by label; 0 where there is none."""
    loss = scoring.masked_cross_entropy(F.col("nll"), F.col("target"))
    return _losses(spark, sf_dir).groupBy("label").agg(arrays.stable(loss).alias("loss"), F.count(F.when(F.col("target") != -100, 1)).alias("n"))


def cross_entropy_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit gradients of the mean loss, times 1000: softmax less one-hot, 0 where ignored."""
    df = _losses(spark, sf_dir)
    count = df.agg(F.greatest(F.lit(1), F.count(F.when(F.col("target") != -100, 1))).alias("n"))
    df = df.join(F.broadcast(count)).withColumn("scale", F.when(F.col("target") == -100, 0.0).otherwise(F.lit(1000.0) / F.col("n")))  # one row
    grad = F.transform(arrays.softmax(F.col("x")), lambda p, i: (p - F.when(i == F.col("target"), 1.0).otherwise(0.0)) * F.col("scale"))
    return _long(df, grad)


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits in steps of a quarter, so that there are ties."""
    return _vectors(spark, sf_dir).select("vec_id", F.transform("x", lambda v: F.floor(v * 4).cast("double")).alias("x"))


def top_k_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits that a top-8 filter keeps, ties at the threshold included."""
    masked = _coarse(spark, sf_dir).select("vec_id", F.posexplode(arrays.top_k_masked(F.col("x"), TOP_K)).alias("i", "value"))
    return masked.where(F.col("value") > float("-inf"))


def argmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice: the first of equal largest logits."""
    return _coarse(spark, sf_dir).select("vec_id", arrays.argmax(F.col("x")).alias("choice"))


def gradient_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global norm over all vectors, and the factor that clips it to 1."""
    rows = _vectors(spark, sf_dir).select(arrays.dot(F.col("x"), F.col("x")).alias("s"))
    return rows.agg(F.sqrt(F.sum("s")).alias("norm")).select(arrays.stable(F.col("norm"), 4).alias("norm"), arrays.stable(F.least(F.lit(1.0), 1.0 / F.col("norm"))).alias("scale"))


QUERIES = {
    f.__name__: f
    for f in (rmsnorm, rmsnorm_dx, rope, rope_round_trip, swiglu, swiglu_grads, softmax_rows, logsumexp_tiles, masked_cross_entropy, cross_entropy_backward, top_k_ties, argmax_rows, gradient_norm)
}

_X = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    x AS (SELECT vec_id, label, CAST(unnest(range(len(v))) AS INTEGER) AS i, unnest(v) AS x FROM e)"""
_R = "round({}, 6) + 0.0 AS value"
_ROPE = f"""{_X},
    p AS (SELECT vec_id, i, x, lead(x, 32) OVER w AS up, lag(x, 32) OVER w AS down, (vec_id % 128) * pow(10000.0::DOUBLE, -2.0::DOUBLE * (i % 32) / 64) AS a FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i))"""
_LOSS = f"""{_X},
    z AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM x),
    l AS (SELECT vec_id, any_value(label) AS label, any_value(m) + ln(sum(exp(x - m))) AS lse, sum(CASE WHEN i = vec_id % 64 THEN x ELSE 0 END) AS hit, vec_id % 5 <> 0 AS valid FROM z GROUP BY vec_id)"""

ORACLE = {
    "rmsnorm": f"WITH {_X} SELECT vec_id, i, {_R.format('x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-6) * (1 + i / 64.0::DOUBLE)')} FROM x",
    "rmsnorm_dx": f"""WITH {_X}, d AS (SELECT a.vec_id, a.i, a.x, b.x * (1 + a.i / 64.0::DOUBLE) AS g FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i = 63 - a.i),
        s AS (SELECT *, 1 / sqrt(avg(x * x) OVER w + 1e-6) AS r, avg(g * x) OVER w AS c FROM d WINDOW w AS (PARTITION BY vec_id))
        SELECT vec_id, i, {_R.format('r * g - x * r * r * r * c')} FROM s""",
    "rope": f"WITH {_ROPE} SELECT vec_id, i, {_R.format('x * cos(a) + CASE WHEN i < 32 THEN -up ELSE down END * sin(a)')} FROM p",
    "rope_round_trip": f"WITH {_X} SELECT vec_id, i, {_R.format('x')} FROM x",
    "swiglu": f"WITH {_X} SELECT a.vec_id, a.i, {_R.format('a.x / (1 + exp(-a.x)) * b.x')} FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i = a.i + 32 WHERE a.i < 32",
    "swiglu_grads": f"""WITH {_X}, j AS (SELECT a.vec_id, a.i, a.x AS a, b.x AS b, c.x AS dy, 1 / (1 + exp(-a.x)) AS s
            FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i = a.i + 32 JOIN x c ON a.vec_id = c.vec_id AND c.i = 31 - a.i WHERE a.i < 32)
        SELECT vec_id, i, round(dy * b * s * (1 + a * (1 - s)), 6) + 0.0 AS da, round(dy * a * s, 6) + 0.0 AS db FROM j""",
    "softmax_rows": f"""WITH {_X}, m AS (SELECT *, exp((x - max(x) OVER (PARTITION BY vec_id)) / 0.5) AS e FROM x)
        SELECT vec_id, i, {_R.format('e / sum(e) OVER (PARTITION BY vec_id)')} FROM m""",
    "logsumexp_tiles": f"""WITH {_X}, m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM x)
        SELECT vec_id, round(any_value(m) + ln(sum(exp(x - m))), 6) + 0.0 AS lse, round(any_value(m) + ln(sum(exp(x - m))), 6) + 0.0 AS whole FROM m GROUP BY vec_id""",
    "masked_cross_entropy": f"""WITH {_LOSS}
        SELECT label, round(sum(CASE WHEN valid THEN lse - hit ELSE 0 END) / greatest(1, count(*) FILTER (WHERE valid)), 6) + 0.0 AS loss, count(*) FILTER (WHERE valid) AS n FROM l GROUP BY label""",
    "cross_entropy_backward": f"""WITH {_X}, m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM x),
        n AS (SELECT greatest(1, count(*)) AS n FROM embeddings WHERE vec_id % 5 <> 0)
        SELECT vec_id, i, {_R.format('CASE WHEN vec_id % 5 = 0 THEN 0 ELSE (e / sum(e) OVER (PARTITION BY vec_id) - CASE WHEN i = vec_id % 64 THEN 1 ELSE 0 END) * 1000 / n END')} FROM m, n""",
    "top_k_ties": f"""WITH {_X}, q AS (SELECT vec_id, i, CAST(floor(x * 4) AS DOUBLE) AS value, rank() OVER (PARTITION BY vec_id ORDER BY floor(x * 4) DESC) AS r FROM x)
        SELECT vec_id, i, value FROM q WHERE r <= {TOP_K}""",
    "argmax_rows": f"""WITH {_X}, q AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY floor(x * 4) DESC, i) AS r FROM x)
        SELECT vec_id, i AS choice FROM q WHERE r = 1""",
    "gradient_norm": f"WITH {_X}, s AS (SELECT sqrt(sum(x * x)) AS norm FROM x) SELECT round(norm, 4) + 0.0 AS norm, round(least(1.0, 1.0 / norm), 6) + 0.0 AS scale FROM s",
}
