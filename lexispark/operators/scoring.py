"""Evaluation: perplexity, multiple choice, code problems, result tables."""

from __future__ import annotations

import os
import resource
import subprocess
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metrics in display order with label, whether lower is better, and chance level.
METRICS = [
    ("perplexity", "Perplexity", True, None),
    ("arc_easy", "ARC-Easy", False, 0.25),
    ("arc_challenge", "ARC-Challenge", False, 0.25),
    ("mmlu", "MMLU", False, 0.25),
    ("humaneval", "HumanEval", False, 0.0),
]
ROW_ORDER = ["base", "sft", "grpo"]


def perplexity(nll: Column) -> Column:
    """Aggregate: exp of the token-weighted mean negative log-likelihood."""
    return F.exp(F.coalesce(F.sum(nll), F.lit(0.0)) / F.greatest(F.lit(1), F.count(nll)))


def perplexity_of_sums(nll: Column, n: Column) -> Column:
    """Aggregate: the same from sums over several tokens and their numbers."""
    return F.exp(F.coalesce(F.sum(nll), F.lit(0.0)) / F.greatest(F.lit(1), F.coalesce(F.sum(n), F.lit(0))))


def batch_mean_loss(losses: DataFrame, batch: str, nll: str = "nll") -> DataFrame:
    """Mean over batches of each batch's mean (batches weigh the same, whatever their size)."""
    return losses.groupBy(batch).agg(F.avg(nll).alias("mean")).agg(F.avg("mean").alias("loss"))


def masked_cross_entropy(nll: Column, target: Column, ignore: int = -100) -> Column:
    """Aggregate: mean over supervised targets; 0 where there is none."""
    valid = (target != ignore).cast("double")
    return F.sum(F.when(target != ignore, nll).otherwise(0.0)) / F.greatest(F.lit(1.0), F.sum(valid))


def tiled_logsumexp(logits: DataFrame, row: list[str], tile: Column, value: str = "logit") -> DataFrame:
    """Log-sum-exp per row from per-tile (max, sum of exp) pairs, merged: memory follows the
    tile, and the tiles' partial results are all that is shuffled."""
    tiles = logits.withColumn("tile", tile)
    peak = F.max(value).over(Window.partitionBy(*row, "tile"))
    partial = tiles.withColumn("m", peak).groupBy(*row, "tile", "m").agg(F.sum(F.exp(F.col(value) - F.col("m"))).alias("s"))
    top = partial.withColumn("top", F.max("m").over(Window.partitionBy(*row)))
    return top.groupBy(*row).agg((F.max("top") + F.log(F.sum(F.col("s") * F.exp(F.col("m") - F.col("top"))))).alias("lse"))


def choice_accuracy(scored: DataFrame, *, question: str = "q_id", choice: str = "choice", answer: str = "answer", logp: str = "logp") -> DataFrame:
    """Accuracy of the length-normalised choice from token rows (question, choice, answer, logp).

    A choice without tokens has a row with a null logp and scores minus infinity; of equal
    scores the first choice wins; without questions the accuracy is 0.
    """
    score = F.coalesce(F.sum(logp) / F.count(logp), F.lit(float("-inf")))
    choices = scored.groupBy(question, answer, choice).agg(F.when(F.count(logp) == 0, float("-inf")).otherwise(score).alias("score"))
    best = choices.groupBy(question, answer).agg(F.max_by(choice, F.struct("score", -F.col(choice))).alias("pred"))
    return best.agg(F.coalesce(F.avg((F.col("pred") == F.col(answer)).cast("double")), F.lit(0.0)).alias("accuracy"))


def program(prompt: Column, completion: Column, test: Column, entry_point: Column) -> Column:
    return F.concat(prompt, completion, F.lit("\n\n"), test, F.lit("\n\ncheck("), entry_point, F.lit(")\n"))


#: Bytes of address space that a program may take.
PROGRAM_MEMORY = 1 << 30


def _bounded() -> None:
    resource.setrlimit(resource.RLIMIT_AS, (PROGRAM_MEMORY, PROGRAM_MEMORY))


def run_program(source: str, timeout: float = 5.0) -> bool:
    """Whether a program ends cleanly in a child interpreter.

    The child has a limit of time and of memory and an empty environment and folder, but no
    further isolation: only run programs that you would run yourself.
    """
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "program.py")
        with open(path, "w", encoding="utf-8") as file:
            file.write(source)
        try:
            done = subprocess.run([sys.executable, "-I", path], capture_output=True, timeout=timeout, cwd=folder, env={}, check=False, preexec_fn=_bounded)
        except subprocess.TimeoutExpired:
            return False
        return done.returncode == 0


def pass_rate(programs: DataFrame, source: str = "program", timeout: float = 5.0, *, allow_execution: bool = False) -> DataFrame:
    """pass@1 of program rows; running code must be allowed explicitly."""
    if not allow_execution:
        raise PermissionError("pass_rate runs code: call it with allow_execution=True")

    @F.arrow_udf("boolean")
    def passed(texts: pa.Array) -> pa.Array:
        return pa.array([run_program(text, timeout) for text in texts.to_pylist()], pa.bool_())

    return programs.agg(F.coalesce(F.avg(passed(F.col(source)).cast("double")), F.lit(0.0)).alias("pass_rate"))


def metric_rows(**parts: DataFrame | None) -> DataFrame | None:
    """(metric, value) rows of the one-value frames that were given, in the metrics' order."""
    found = None
    for name, *_ in METRICS:
        if (df := parts.get(name)) is not None:
            row = df.select(F.lit(name).alias("metric"), F.col(df.columns[0]).cast("double").alias("value"))
            found = row if found is None else found.unionByName(row)
    return found


def formatted(metric: Column, value: Column) -> Column:
    """Two decimals for perplexity, percent with one otherwise, a dash for no value."""
    return F.when(value.isNull(), "—").when(metric == "perplexity", F.format_string("%.2f", value)).otherwise(F.concat(F.format_string("%.1f", value * 100), F.lit("%")))


def row_rank(checkpoint: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROW_ORDER)), checkpoint), F.lit(0)), F.lit(99))


def header(name: str, label: str, lower: bool, chance: float | None) -> str:
    return f"{label}{' (lower is better)' if lower else ''}" if chance is None else f"{label} (chance {chance:.0%})"


def report(results: DataFrame) -> str:
    """Markdown table of (checkpoint, metric, value) rows: checkpoints in training order, the
    metrics that occur in display order. The result set is a few rows by nature."""
    named = [m[0] for m in METRICS]
    pivoted = results.groupBy("checkpoint").pivot("metric", named).agg(F.first("value"))
    rows = pivoted.orderBy(row_rank(F.col("checkpoint")), "checkpoint").select("checkpoint", *[formatted(F.lit(n), F.col(n)).alias(n) for n in named]).collect()
    present = [m for m in METRICS if any(r[m[0]] != "—" for r in rows)]
    lines = ["| " + " | ".join(["Checkpoint", *(header(*m) for m in present)]) + " |", "|" + "---|" * (len(present) + 1)]
    lines += ["| " + " | ".join([r["checkpoint"], *(r[m[0]] for m in present)]) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def results_json(results: DataFrame) -> DataFrame:
    """One JSON text: {"chance_baselines": .., "checkpoints": {name: {metric: value}}}, keys sorted."""

    def entries(key: str, value: str) -> Column:
        pairs = F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))  # maps have no order of their own
        return F.map_from_entries(F.array_sort(pairs, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))

    by_checkpoint = results.groupBy("checkpoint").agg(entries("metric", "value").alias("metrics"))
    chance = F.create_map(*[x for m in sorted(METRICS) for x in (F.lit(m[0]), F.lit(m[3]).cast("double"))])
    return by_checkpoint.agg(entries("checkpoint", "metrics").alias("checkpoints")).select(F.to_json(F.struct(chance.alias("chance_baselines"), "checkpoints"), {"ignoreNullFields": "false"}).alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    """Store a result set as one JSON line at any path that Spark can write."""
    results_json(results).coalesce(1).write.mode("overwrite").text(path)


def load_results(spark, path: str) -> DataFrame:
    return read_results(spark.read.text(path), "value")


def read_results(json_text: DataFrame, column: str = "json") -> DataFrame:
    """(checkpoint, metric, value) rows of such a text."""
    parsed = json_text.select(F.from_json(column, "checkpoints map<string, map<string, double>>").alias("r"))
    return parsed.select(F.explode("r.checkpoints").alias("checkpoint", "m")).select("checkpoint", F.explode("m").alias("metric", "value"))
