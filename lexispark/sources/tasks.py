"""Task sources: conversations, question banks, multiple-choice and code problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import rng
from lexispark.functions.rewards import final_int
from lexispark.sources.corpus import read_jsonl, read_rows

CONVERSATION = "messages array<struct<role: string, content: string>>"
QUESTION = "prompt string, choices array<string>, answer int"
PROBLEM = "prompt string, test string, entry_point string"


def load_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, messages) of a JSON-lines file or folder; conv_id numbers the conversations in file
    order, however the files are split."""
    own = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("split")
    parsed = F.from_json("value", CONVERSATION, {"mode": "FAILFAST"})["messages"].alias("messages")
    lines = spark.read.text(path, lineSep="\n").select(own, "value").where(F.trim("value") != "").select("split", parsed).where("messages IS NOT NULL")
    rows = lines.select("split", F.monotonically_increasing_id().alias("at"), "messages")  # ascends in a split
    splits = rows.groupBy("split").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))  # a row per split
    first = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(splits.select("split", "low", first.alias("first"))), "split").select((F.col("first") + F.col("at") - F.col("low")).alias("conv_id"), "messages")


def first_valid(rows: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first ``limit`` rows in order, counted after filtering."""
    return rows if limit is None else rows.orderBy(order).limit(limit)


def question_bank(rows: DataFrame, *, key: str, question: str, answer: str, max_new: int, limit: int | None = None) -> DataFrame:
    """(key, question, gold, max_new): commas leave the answer, rows without an integer leave
    the bank, and the limit counts what is left."""
    gold = final_int(F.regexp_replace(answer, ",", ""))
    bank = rows.select(key, F.col(question).alias("question"), gold.alias("gold")).where("gold IS NOT NULL")
    return first_valid(bank, key, limit).withColumn("max_new", F.lit(max_new))


def arithmetic_bank(spark: SparkSession, n: int, max_new: int = 16, seed: int = 0) -> DataFrame:
    """(prompt_id, question, gold, max_new): sums of two numbers from 0 to 20."""
    a, b = (rng.integer(seed, F.col("id"), x, 0, 20) for x in ("a", "b"))
    rows = spark.range(n).select(F.col("id").alias("prompt_id"), a.alias("a"), b.alias("b"))
    return rows.select("prompt_id", F.format_string("What is %d + %d?", "a", "b").alias("question"), (F.col("a") + F.col("b")).cast("bigint").alias("gold"), F.lit(max_new).alias("max_new"))


def synthetic_conversations(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(conv_id, messages): arithmetic questions with operands 0 to 50; three in ten have a
    second turn that adds 1 to 20."""
    i = F.col("id")
    rows = spark.range(n).select(
        i.alias("conv_id"), rng.integer(seed, i, "a", 0, 50).alias("a"), rng.integer(seed, i, "b", 0, 50).alias("b"),
        rng.pick(seed, i, "op", ["+", "-", "*"]).alias("op"), (rng.uniform(seed, i, "more") < 0.3).alias("more"), rng.integer(seed, i, "c", 1, 20).alias("c"),
    )
    result = F.when(F.col("op") == "+", F.col("a") + F.col("b")).when(F.col("op") == "-", F.col("a") - F.col("b")).otherwise(F.col("a") * F.col("b"))
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    first = F.array(say("user", F.format_string("What is %d %s %d?", "a", "op", "b")), say("assistant", result.cast("string")))
    second = F.array(say("user", F.format_string("Now add %d.", "c")), say("assistant", (result + F.col("c")).cast("string")))
    return rows.select("conv_id", F.when(F.col("more"), F.concat(first, second)).otherwise(first).alias("messages"))


def question_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def spaced(choices: Column) -> Column:
    return F.transform(choices, lambda c: F.concat(F.lit(" "), c))


def keyed_questions(rows: DataFrame, *, key: str = "q_id", limit: int | None = None) -> DataFrame:
    """(key, prompt, choices, answer) of (key, question, labels, texts, answer_key) rows whose
    key is one of the labels."""
    usable = rows.where(F.array_contains("labels", F.col("answer_key")))
    made = usable.select(key, question_prompt(F.col("question")).alias("prompt"), spaced(F.col("texts")).alias("choices"), (F.array_position("labels", F.col("answer_key")) - 1).cast("int").alias("answer"))
    return first_valid(made, key, limit)


def indexed_questions(rows: DataFrame, *, key: str = "q_id", limit: int | None = None) -> DataFrame:
    """The same for (key, question, choices, answer) rows with an integer answer."""
    made = rows.select(key, question_prompt(F.col("question")).alias("prompt"), spaced(F.col("choices")).alias("choices"), F.col("answer").cast("int").alias("answer"))
    return first_valid(made, key, limit)


def code_problems(rows: DataFrame, *, key: str = "q_id", limit: int | None = None) -> DataFrame:
    return first_valid(rows, key, limit).select("prompt", "test", "entry_point")


# --- local copies of public task sets, Parquet or JSON lines --------------------------------


def load_word_problems(spark: SparkSession, path: str, *, max_new: int = 256, limit: int | None = None) -> DataFrame:
    """Bank of (question, answer) rows whose answer ends with a mark and the number."""
    rows = numbered_rows(read_rows(spark, path, "question string, answer string"), ["question", "answer"], "prompt_id")
    final = F.regexp_extract("answer", r"(?s).*####\s*(.*)$", 1)
    return question_bank(rows.withColumn("final", final), key="prompt_id", question="question", answer="final", max_new=max_new, limit=limit)


def load_keyed(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """Questions of (id, question, choices: text and label, answerKey) rows."""
    rows = read_rows(spark, path, "id string, question string, choices struct<text: array<string>, label: array<string>>, answerKey string")
    named = rows.select(F.col("id").alias("q_id"), "question", F.col("choices.label").alias("labels"), F.col("choices.text").alias("texts"), F.col("answerKey").alias("answer_key"))
    return keyed_questions(named, limit=limit).drop("q_id")


def load_indexed(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """Questions of (question, choices, answer: a number) rows."""
    rows = numbered_rows(read_rows(spark, path, "question string, choices array<string>, answer int"), ["question", "choices"], "q_id")
    return indexed_questions(rows, limit=limit).drop("q_id")


def load_problems(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """Code problems of (task_id, prompt, test, entry_point) rows."""
    rows = read_rows(spark, path, "task_id string, prompt string, test string, entry_point string")
    number = F.coalesce(F.try_to_number(F.regexp_extract("task_id", r"(\d+)$", 1), F.lit("999999999")).cast("bigint"), F.lit(0))
    return code_problems(rows.withColumn("q_id", F.struct(number.alias("n"), F.col("task_id"))), limit=limit)


def numbered_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with a name for ``first_valid`` to order by: the values themselves, so that a limit
    chooses the same rows however files are split."""
    return rows.withColumn(name, F.struct(*order))


#: Loaders by metric, for ``register_task(metric, local(metric, path))``.
LOADERS: dict[str, Callable[..., DataFrame]] = {"arc_easy": load_keyed, "arc_challenge": load_keyed, "mmlu": load_indexed, "humaneval": load_problems}


def local(metric: str, path: str) -> Callable[[SparkSession, int | None], DataFrame]:
    """A task set that reads a local copy."""
    return lambda spark, limit: LOADERS[metric](spark, path, limit=limit)


def sample_questions(spark: SparkSession) -> DataFrame:
    """Two questions for dry runs."""
    # Fixed values.
    rows = [("The sky is", [" blue", " loud"], 0), ("Two plus two equals", [" four", " purple"], 0)]
    return spark.createDataFrame(rows, QUESTION)


def sample_problems(spark: SparkSession) -> DataFrame:
    """One code problem for dry runs."""
    # Fixed values.
    rows = [("def add(a, b):\n    ", "def check(candidate):\n    assert candidate(1, 2) == 3\n", "add")]
    return spark.createDataFrame(rows, PROBLEM)


TASKS: dict[str, Callable[[SparkSession, int | None], DataFrame]] = {}


def register_task(name: str, make: Callable[[SparkSession, int | None], DataFrame]) -> None:
    """Add a named task set: a function of (spark, limit)."""
    TASKS[name] = make


def resolve_tasks(spark: SparkSession, spec: str | None, metric: str, limit: int | None = None) -> DataFrame | None:
    """A metric's task set: None for none, ``sample``, a registered name (``table`` looks up the
    metric's own name), or the path of a JSON-lines file. The limit is for registered sets."""
    code = metric == "humaneval"
    if spec is None:
        return None
    if spec == "sample":
        return sample_problems(spark) if code else sample_questions(spark)
    if spec in TASKS or spec == "table":
        return TASKS[metric if spec == "table" else spec](spark, limit)
    return read_jsonl(spark, spec, PROBLEM if code else QUESTION)
