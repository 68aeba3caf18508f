"""Scoring a logits provider on tables of windows, questions and code problems."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.functions.bpe import BpeTokenizer
from lexispark.model.generation import generate_all
from lexispark.model.providers import Provider, target_logprobs
from lexispark.operators import scoring

#: Sequences that a provider sees at once, unless it says otherwise.
ROWS_AT_A_TIME = 64


def equal_lengths(column: pa.Array, rows: int) -> Iterator[np.ndarray]:
    """The sequences of a list column as matrices of up to ``rows`` of one length, in any order; those
    that are null or shorter than two have no target and are left out."""
    column = column.drop_null()
    values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    lengths = np.diff(ends, prepend=0)
    for n in np.unique(lengths[lengths > 1]):
        starts = (ends - lengths)[lengths == n]
        for a in range(0, len(starts), rows):
            yield values[starts[a : a + rows, None] + np.arange(n)]


def perplexity(windows: DataFrame, provider: Provider, tokens: str = "tokens") -> DataFrame:
    """Token-weighted perplexity of windows: one row (perplexity).

    A task sends on sums, one row a batch, and never holds logits that it does not need.
    """
    shared = windows.sparkSession.sparkContext.broadcast(provider)

    def run(batches):
        model = shared.value
        rows = getattr(model, "rows_at_a_time", ROWS_AT_A_TIME)
        for batch in batches:
            total, n = 0.0, 0
            for x in equal_lengths(batch.column(0), rows):
                total -= float(target_logprobs(model, x[:, :-1], x[:, 1:]).sum())
                n += x[:, 1:].size
            yield pa.RecordBatch.from_pydict({"nll": [total], "n": [n]}, schema=pa.schema([("nll", pa.float64()), ("n", pa.int64())]))

    sums = windows.select(tokens).mapInArrow(run, "nll double, n bigint")
    return sums.agg(scoring.perplexity_of_sums(F.col("nll"), F.col("n")).alias("perplexity"))


def sequence_logprobs(rows: DataFrame, provider: Provider, *, key: list[str], tokens: str = "tokens") -> DataFrame:
    """(key, n, logp): targets of each row's sequence and the sum of their log-probabilities; 0 and 0.0 where
    there is none."""
    shared = rows.sparkSession.sparkContext.broadcast(provider)
    named = rows.select(*key, tokens)
    schema = T.StructType([*named.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("logp", T.DoubleType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            n, logp = [], []
            for ids in batch.column(len(key)):
                x = np.asarray(ids.values, np.int64)[None] if ids.is_valid else np.empty((1, 0), np.int64)
                n.append(max(0, x.shape[1] - 1))
                logp.append(float(target_logprobs(model, x[:, :-1], x[:, 1:]).sum()) if x.shape[1] > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(n, pa.int64()), pa.array(logp, pa.float64())], names=[f.name for f in schema])

    return named.mapInArrow(run, schema)


def choice_logprobs(questions: DataFrame, provider: Provider, tokenizer: BpeTokenizer, *, key: str = "q_id") -> DataFrame:
    """(q_id, choice, answer, logp) rows, one per token of each choice; a choice without tokens
    has one row with a null. The prompt starts with bos, so that even an empty prompt has a
    position that predicts the first token."""
    shared = questions.sparkSession.sparkContext.broadcast((provider, tokenizer))

    def run(batches):
        model, coder = shared.value
        for batch in batches:
            out = {"q_id": [], "choice": [], "answer": [], "logp": []}
            for q, prompt, choices, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                context = coder.encode(prompt, add_bos=True)
                for j, choice in enumerate(choices):
                    ids = coder.encode(choice)
                    logs: list[float | None] = [None]
                    if ids:
                        whole = np.array([context + ids])
                        logs = target_logprobs(model, whole[:, :-1], whole[:, 1:])[0, len(context) - 1 :].tolist()
                    for name, values in (("q_id", [q] * len(logs)), ("choice", [j] * len(logs)), ("answer", [answer] * len(logs)), ("logp", logs)):
                        out[name] += values
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("q_id", pa.int64()), ("choice", pa.int32()), ("answer", pa.int32()), ("logp", pa.float64())]))

    return questions.select(F.col(key).cast("bigint"), "prompt", "choices", "answer").mapInArrow(run, "q_id bigint, choice int, answer int, logp double")


def multiple_choice(questions: DataFrame, provider: Provider, tokenizer: BpeTokenizer, *, key: str = "q_id") -> DataFrame:
    return scoring.choice_accuracy(choice_logprobs(questions, provider, tokenizer, key=key))


def programs(problems: DataFrame, provider: Provider, tokenizer: BpeTokenizer, *, max_new: int = 256) -> DataFrame:
    """(program): greedily completed prompts with their tests."""
    shared = problems.sparkSession.sparkContext.broadcast((provider, tokenizer))

    def run(batches):
        model, coder = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(a, ROWS_AT_A_TIME)
                prompts = [coder.encode(p) for p in part.column(0).to_pylist()]
                texts = [coder.decode(new) for new in generate_all(model, prompts, max_new=max_new, eos=coder.eos_id)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["prompt", "test", "entry_point", "completion"])

    done = problems.select("prompt", "test", "entry_point").mapInArrow(run, "prompt string, test string, entry_point string, completion string")
    return done.select(scoring.program(F.col("prompt"), F.col("completion"), F.col("test"), F.col("entry_point")).alias("program"))


def evaluate(provider: Provider, tokenizer: BpeTokenizer, *, windows: DataFrame | None = None, arc_easy: DataFrame | None = None, arc_challenge: DataFrame | None = None, mmlu: DataFrame | None = None, humaneval: DataFrame | None = None, max_new: int = 256, allow_execution: bool = False) -> DataFrame | None:
    """(metric, value) of every metric whose input is given."""
    choice = lambda q: None if q is None else multiple_choice(q, provider, tokenizer)
    return scoring.metric_rows(
        perplexity=None if windows is None else perplexity(windows, provider),
        arc_easy=choice(arc_easy), arc_challenge=choice(arc_challenge), mmlu=choice(mmlu),
        humaneval=None if humaneval is None else scoring.pass_rate(programs(humaneval, provider, tokenizer, max_new=max_new), allow_execution=allow_execution),
    )
