"""Scoring and report queries, with providers fitted on driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.arrays import stable
from lexispark.operators import scoring
from lexispark.session import table
from lexispark.sources import tasks


def _bigram_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative log-likelihood of each next event type under an add-one bigram model."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    pairs = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("token")).withColumn("before", F.lag("token").over(w)).where("before IS NOT NULL")
    counts = pairs.groupBy("before", "token").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("before").agg(F.sum("c").alias("n"))
    size = pairs.agg(F.countDistinct("token").alias("v"))
    model = counts.join(totals, "before").join(F.broadcast(size)).select("before", "token", (-F.log((F.col("c") + 1) / (F.col("n") + F.col("v")))).alias("nll"))
    return pairs.join(model, ["before", "token"])


def perplexity_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-weighted perplexity by user bucket."""
    rows = _bigram_nll(spark, sf_dir)
    return rows.groupBy((F.col("user_id") % 10).alias("bucket")).agg(stable(scoring.perplexity(F.col("nll"))).alias("perplexity"), F.count(F.lit(1)).alias("n_tokens"))


def batch_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of batch means: batches of unequal size weigh the same."""
    rows = _bigram_nll(spark, sf_dir).withColumn("batch", F.col("user_id") % 8)
    return scoring.batch_mean_loss(rows, "batch").select(stable(F.col("loss")).alias("loss"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token log-probabilities of four choices a question, of 60 to 64 tokens; every 13th choice has
    none."""
    df = table(spark, sf_dir, "embeddings")
    logs = F.transform(F.col("embedding"), lambda v: -F.abs(F.floor(v * 8).cast("double")))
    own = F.when(F.col("vec_id") % 13 == 0, F.array().cast("array<double>")).otherwise(F.slice(logs, F.lit(1), (F.size("embedding") - F.col("vec_id") % 5).cast("int")))
    return df.select(F.expr("vec_id div 4").alias("q_id"), (F.col("vec_id") % 4).cast("int").alias("choice"), (F.expr("vec_id div 4") % 4).cast("int").alias("answer"), F.explode_outer(own).alias("logp"))


def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice accuracy by length-normalised log-likelihood; first of equal choices."""
    return scoring.choice_accuracy(_choices(spark, sf_dir)).select(stable(F.col("accuracy")).alias("accuracy"))


def keyed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose answer key is a label, the first 25: prompt, second choice, answer."""
    df = table(spark, sf_dir, "benchmark")
    words = F.split("text", " ")
    rows = df.select(
        F.col("item_id").alias("q_id"), F.col("text").alias("question"), F.array(*map(F.lit, "ABCD")).alias("labels"), words.alias("texts"),
        F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("item_id") % 5 + 1).cast("int")).alias("answer_key"),
    )
    made = tasks.keyed_questions(rows, limit=25)
    return made.select("q_id", "prompt", F.get("choices", F.lit(1)).alias("second"), "answer")


def indexed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same template for questions with an integer answer."""
    df = table(spark, sf_dir, "benchmark")
    rows = df.select(F.col("item_id").alias("q_id"), F.col("text").alias("question"), F.split("text", " ").alias("choices"), (F.col("item_id") % 4).alias("answer"))
    return tasks.indexed_questions(rows).select("q_id", "prompt", F.array_join("choices", "|").alias("choices"), "answer")


def sample_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in questions, one row per choice."""
    rows = tasks.resolve_tasks(spark, "sample", "mmlu")
    return rows.select("prompt", "answer", F.posexplode("choices").alias("choice", "text"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(checkpoint, metric, value): rates over labels, with gaps; stand-ins for models."""
    df = table(spark, sf_dir, "labels")
    names = F.array(*map(F.lit, ["sft", "base", "alpha", "grpo"]))
    rows = df.withColumn("checkpoint", F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")))
    means = rows.groupBy("checkpoint").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"), (F.lit(10.0) + F.avg(F.col("doc_id") % 7)).alias("p"))
    return means.select("checkpoint", F.explode(F.create_map(F.lit("perplexity"), F.col("p"), F.lit("arc_easy"), F.col("q"), F.lit("humaneval"), F.when(F.col("checkpoint") != "base", F.col("t")))).alias("metric", "value")).where("value IS NOT NULL")


def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivoted, formatted report with its row order; gaps are dashes."""
    named = ["perplexity", "arc_easy", "arc_challenge", "humaneval"]
    pivoted = _results(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 100000 + 0.5) / 100000).groupBy("checkpoint").pivot("metric", named).agg(F.first("value"))
    cells = pivoted.select("checkpoint", scoring.row_rank(F.col("checkpoint")).alias("rank"), *[scoring.formatted(F.lit(n), F.col(n)).alias(n) for n in named])
    return cells.select("checkpoint", F.row_number().over(Window.orderBy("rank", "checkpoint")).alias("place"), *named)


def results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as one JSON text and read again."""
    back = scoring.read_results(scoring.results_json(_results(spark, sf_dir)))
    return back.select("checkpoint", "metric", stable(F.col("value")).alias("value"))


def metric_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics whose inputs are there, as one result set."""
    ppl = _bigram_nll(spark, sf_dir).agg(scoring.perplexity(F.col("nll")).alias("v"))
    found = scoring.metric_rows(perplexity=ppl, arc_easy=scoring.choice_accuracy(_choices(spark, sf_dir)), mmlu=None)
    return found.select("metric", stable(F.col("value")).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (perplexity_bigram, batch_mean_loss, choice_accuracy, keyed_questions, indexed_questions, sample_tasks, report_cells, results_round_trip, metric_union)
}

_NLL = """p AS (SELECT user_id, event_type AS token, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    k AS (SELECT * FROM p WHERE before IS NOT NULL),
    c AS (SELECT before, token, count(*) AS c FROM k GROUP BY 1, 2),
    t AS (SELECT before, sum(c) AS n FROM c GROUP BY 1),
    nll AS (SELECT k.user_id, -ln((c + 1) / CAST(n + (SELECT count(DISTINCT token) FROM k) AS DOUBLE)) AS nll FROM k JOIN c USING (before, token) JOIN t USING (before))"""
_MC = """e AS (SELECT vec_id // 4 AS q, vec_id % 4 AS choice, (vec_id // 4) % 4 AS answer, vec_id, embedding FROM embeddings),
    x AS (SELECT vec_id, unnest(range(CASE WHEN vec_id % 13 = 0 THEN 0 ELSE len(embedding) - vec_id % 5 END)) AS i, embedding FROM e),
    s AS (SELECT vec_id, sum(-abs(floor(CAST(embedding[i + 1] AS DOUBLE) * 8))) / count(*) AS score FROM x GROUP BY vec_id),
    r AS (SELECT q, choice, answer, row_number() OVER (PARTITION BY q ORDER BY coalesce(score, -1e308) DESC, choice) AS r FROM e LEFT JOIN s USING (vec_id)),
    acc AS (SELECT coalesce(avg(CASE WHEN choice = answer THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0) AS accuracy FROM r WHERE r = 1)"""
_RES = """m AS (
        SELECT CASE doc_id % 4 WHEN 0 THEN 'sft' WHEN 1 THEN 'base' WHEN 2 THEN 'alpha' ELSE 'grpo' END AS checkpoint, avg(quality) AS q, avg(toxic) AS t, 10.0::DOUBLE + avg(doc_id % 7) AS p
        FROM labels GROUP BY 1),
    res AS (SELECT checkpoint, 'perplexity' AS metric, p AS value FROM m UNION ALL SELECT checkpoint, 'arc_easy', q FROM m UNION ALL SELECT checkpoint, 'humaneval', t FROM m WHERE checkpoint <> 'base')"""
_CELL = "max(CASE WHEN metric = '{0}' THEN {1} END)"
_PCT = "printf('%.1f', floor(value * 100000 + 0.5) / 100000 * 100) || '%'"

ORACLE = {
    "perplexity_bigram": f"WITH {_NLL} SELECT user_id % 10 AS bucket, round(exp(sum(nll) / count(*)), 6) + 0.0 AS perplexity, count(*) AS n_tokens FROM nll GROUP BY 1",
    "batch_mean_loss": f"WITH {_NLL}, b AS (SELECT avg(nll) AS m FROM nll GROUP BY user_id % 8) SELECT round(avg(m), 6) + 0.0 AS loss FROM b",
    "choice_accuracy": f"WITH {_MC} SELECT round(accuracy, 6) + 0.0 AS accuracy FROM acc",
    "keyed_questions": """
        SELECT item_id AS q_id, 'Question: ' || text || chr(10) || 'Answer:' AS prompt, ' ' || string_split(text, ' ')[2] AS second, CAST(item_id % 5 AS INTEGER) AS answer
        FROM benchmark WHERE item_id % 5 < 4 ORDER BY item_id LIMIT 25""",
    "indexed_questions": """
        SELECT item_id AS q_id, 'Question: ' || text || chr(10) || 'Answer:' AS prompt,
               array_to_string(list_transform(string_split(text, ' '), lambda c: ' ' || c), '|') AS choices, CAST(item_id % 4 AS INTEGER) AS answer FROM benchmark""",
    "sample_tasks": """
        SELECT prompt, answer, choice, text FROM (VALUES ('The sky is', 0, 0, ' blue'), ('The sky is', 0, 1, ' loud'),
            ('Two plus two equals', 0, 0, ' four'), ('Two plus two equals', 0, 1, ' purple')) v(prompt, answer, choice, text)""",
    "report_cells": f"""WITH {_RES},
        w AS (SELECT checkpoint, {_CELL.format('perplexity', "printf('%.2f', floor(value * 100000 + 0.5) / 100000)")} AS perplexity, {_CELL.format('arc_easy', _PCT)} AS arc_easy, {_CELL.format('humaneval', _PCT)} AS humaneval FROM res GROUP BY checkpoint)
        SELECT checkpoint, CAST(row_number() OVER (ORDER BY CASE checkpoint WHEN 'base' THEN 1 WHEN 'sft' THEN 2 WHEN 'grpo' THEN 3 ELSE 99 END, checkpoint) AS INTEGER) AS place,
               perplexity, arc_easy, '—' AS arc_challenge, coalesce(humaneval, '—') AS humaneval FROM w""",
    "results_round_trip": f"WITH {_RES} SELECT checkpoint, metric, round(value, 6) + 0.0 AS value FROM res",
    "metric_union": f"""WITH {_NLL}, {_MC}
        SELECT 'perplexity' AS metric, round(exp(sum(nll) / count(*)), 6) + 0.0 AS value FROM nll UNION ALL SELECT 'arc_easy', round(accuracy, 6) + 0.0 FROM acc""",
}
