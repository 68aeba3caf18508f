"""Tokenizer, generation and model queries. What has no SQL is checked by the tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import bpe, vocab
from lexispark.functions.arrays import stable
from lexispark.functions.schedule import get_config
from lexispark.model import evaluation, generation, optim, providers, training
from lexispark.model.transformer import init_params
from lexispark.operators import chat, scoring
from lexispark.plans.text import BYTE_AT, BYTE_ID
from lexispark.session import shared_folder, table
from lexispark.sources import corpus, tasks

TINY = {"vocab_size": 384, "d_model": 32, "n_layers": 2, "n_q_heads": 4, "n_kv_heads": 2, "head_dim": 8, "mlp_hidden": 64, "context": 64, "window": 16, "micro_batch": 2, "grad_accum": 1}
#: Tasks of the model's passes for each core: no core waits long for one with larger conversations.
TASKS_A_CORE = 4


def _tokenizer(spark: SparkSession, sf_dir: str, merges: int = 120) -> bpe.BpeTokenizer:
    return bpe.train(table(spark, sf_dir, "conversations"), 264 + merges)


def pretoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pre-tokens of the conversations and their counts (the input of BPE training)."""
    return bpe.word_counts(table(spark, sf_dir, "conversations"))


def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent adjacent byte pairs of lower-case words: words between single spaces stand in for
    pre-tokens, whose pattern has no SQL."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return bpe.pair_counts(words)


def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges learned from the conversations, in rank order."""
    coder = _tokenizer(spark, sf_dir)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(coder.merges)], "rank int, left string, right string")


def bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each turn under the learned vocabulary, and whether decoding returns the text."""
    coder = _tokenizer(spark, sf_dir)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", coder.encode_column(F.col("text")).alias("ids"))
    return rows.select("conv_id", "turn", F.size("ids").cast("bigint").alias("n_tokens"), (coder.decode_column(F.col("ids")) == F.coalesce("text", F.lit(""))).alias("same"))


def synthetic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated documents: words and full stop."""
    docs = corpus.resolve_source(spark, "synthetic", n=500, seed=3)
    return docs.select("doc_id", F.size(F.split("text", " ")).alias("n_words"), F.endswith("text", F.lit(".")).alias("ends"))


def synthetic_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated arithmetic conversations: turns and the last answer."""
    rows = tasks.synthetic_conversations(spark, 500, seed=3)
    return rows.select("conv_id", F.size("messages").alias("n_turns"), F.element_at("messages", -1)["content"].cast("bigint").alias("answer"))


def arithmetic_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated sums."""
    return tasks.arithmetic_bank(spark, 200, seed=5).select("prompt_id", "question", "gold")


def generation_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy replies of a provider that prefers one token: it is repeated to the limit."""
    return _preferred_replies(spark, sf_dir, vocab_id("a"))


def generation_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of one that prefers the end: a reply ends with its first eos, which is no text."""
    return _preferred_replies(spark, sf_dir, 2)


def _preferred_replies(spark: SparkSession, sf_dir: str, token: int) -> DataFrame:
    prompts = chat.render(table(spark, sf_dir, "conversations"), generation_prompt=True)
    ids = prompts.select(F.col("conv_id").alias("group"), F.transform("tokens", lambda t: t["id"]).alias("ids"))
    coder = bpe.BpeTokenizer(bpe.base_tokens(), [])
    out = generation.sample_groups(ids, providers.Preferred(264, [token]), coder, group_size=2, max_new=6, temperature=0.0)
    return out.select("group", "sample", "text", "n_new", "terminated")


def vocab_id(character: str) -> int:
    return next(i for _, c, i in vocab.byte_alphabet() if c == character)


def sampled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a byte bigram model of the conversations, in groups."""
    texts = table(spark, sf_dir, "conversations").select(vocab.with_specials(vocab.byte_ids(F.col("text")), bos=True, eos=True).alias("ids"))
    model = providers.Bigram.fit_table(texts, 264)
    prompts = spark.range(8).select(F.col("id").alias("group"), F.array(F.lit(1)).alias("ids"))
    coder = bpe.BpeTokenizer(bpe.base_tokens(), [])
    return generation.sample_groups(prompts, model, coder, group_size=4, max_new=24, top_k=40, seed=1).select("group", "sample", "n_new", "terminated")


def uniform_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of a uniform provider over windows of all documents: the vocabulary's size."""
    ids = table(spark, sf_dir, "documents").select(vocab.byte_ids(F.col("text")).alias("ids"))
    windows = ids.select(F.explode(windows_of(F.col("ids"), 16)).alias("tokens"))
    return evaluation.perplexity(windows, providers.Uniform(264)).select(stable(F.col("perplexity")).alias("perplexity"))


def windows_of(tokens: Column, size: int) -> Column:
    """Windows of up to size + 1 tokens that overlap by one, so that each token but the first is
    a target once; none where there is no target."""
    starts = F.when(F.size(tokens) > 1, F.sequence(F.lit(1), F.size(tokens) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i, F.lit(size + 1)))


def sample_choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in questions under a provider that prefers the letters of " blue": 1 of 2."""
    coder = bpe.BpeTokenizer(bpe.base_tokens(), [])
    model = providers.Preferred(264, [vocab_id(c) for c in ("Ġ", "b", "l", "u", "e")])
    questions = tasks.sample_questions(spark).withColumn("q_id", F.monotonically_increasing_id())
    return evaluation.multiple_choice(questions, model, coder).select(stable(F.col("accuracy")).alias("accuracy"))


def sample_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled programs of the built-in code problem with a given completion."""
    rows = tasks.sample_problems(spark).withColumn("completion", F.lit("return a + b"))
    return rows.select(scoring.program(F.col("prompt"), F.col("completion"), F.col("test"), F.col("entry_point")).alias("program"))


def transformer_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and gradient norm of an untrained tiny model over windows of all conversations, by
    distributed gradients. Windows without a supervised target add nothing and are not run; padding ends a
    window, so that no supervised token sees it and segments are not needed. Passes run in single precision;
    what is summed over steps and tasks is double."""
    c = get_config("nano", **TINY)
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    windows = chat.supervised_windows(table(spark, sf_dir, "conversations"), c.context, tasks)
    params = {k: v.astype(np.float32) for k, v in init_params(c).items()}
    loss, grads = training.distributed_gradients(windows, params, c, dealt=tasks)
    _, size = optim.clip(grads, c.grad_clip)
    return spark.createDataFrame([(round(float(loss), 6), round(float(size), 6))], "loss double, grad_norm double")


def orthogonalized_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular values of orthogonalised gradient-like matrices, one of each 48 vectors: all near one."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 48").alias("block"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))

    def singular(block: pa.Table) -> pa.Table:
        x = np.array(block.sort_by("vec_id")["x"].to_pylist())
        values = np.linalg.svd(optim.orthogonalized(x), compute_uv=False)
        return pa.table({"block": [block["block"][0].as_py()] * len(values), "i": pa.array(range(len(values)), pa.int32()), "near_one": [bool(0.5 < s < 1.4) for s in values]})

    return rows.groupBy("block").applyInArrow(singular, "block bigint, i int, near_one boolean")


def tokenizer_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose ids are the same under a learned vocabulary and under the one that was saved,
    in its own and in the public layout, and loaded again."""
    coder = _tokenizer(spark, sf_dir, 40)
    path = shared_folder(spark, "tokenizer")
    coder.save(spark, path)
    again, public = bpe.BpeTokenizer.load(spark, path), bpe.BpeTokenizer.from_public_json(coder.to_public_json())
    ids = [c.encode_column(F.col("text")).alias(n) for n, c in (("a", coder), ("b", again), ("c", public))]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *ids).select("conv_id", "turn", ((F.col("a") == F.col("b")) & (F.col("a") == F.col("c"))).alias("same"))


def sample_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pass@1 of the built-in code problem with a right, a wrong, an endless and a broken completion."""
    tries = F.explode(F.array(*map(F.lit, ["return a + b", "return a - b", "while True: pass", "return ("])))
    rows = tasks.sample_problems(spark).withColumn("completion", tries)
    programs = rows.select(scoring.program(F.col("prompt"), F.col("completion"), F.col("test"), F.col("entry_point")).alias("program"))
    return scoring.pass_rate(programs, timeout=2.0, allow_execution=True)


QUERIES = {
    f.__name__: f
    for f in (
        pretoken_words, bpe_pair_counts, bpe_merges, bpe_token_counts, synthetic_documents, synthetic_chats, arithmetic_bank, generation_preferred, generation_ends, sampled_groups,
        uniform_perplexity, sample_choice_accuracy, sample_programs, transformer_loss, orthogonalized_update, tokenizer_round_trip, sample_pass_rate,
    )
}

ORACLE = {
    "bpe_pair_counts": f"""
        WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) t GROUP BY word),
        k AS (SELECT word, n, unnest(range(octet_length(encode(word)))) AS k FROM w),
        b AS (SELECT word, n, k, {BYTE_AT.format(t="word", k="k")} AS b FROM k),
        i AS (SELECT word, n, k, CAST({BYTE_ID} AS INTEGER) AS a FROM b),
        p AS (SELECT a, lead(a) OVER (PARTITION BY word ORDER BY k) AS b, n FROM i)
        SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b HAVING sum(n) >= 2""",
    "generation_preferred": """
        SELECT conv_id AS "group", CAST(sample AS INTEGER) AS sample, 'aaaaaa' AS text, 6 AS n_new, false AS terminated
        FROM (SELECT DISTINCT conv_id FROM conversations) c, (SELECT unnest([0, 1]) AS sample) s""",
    "uniform_perplexity": "SELECT 264.0::DOUBLE AS perplexity",
    "sample_choice_accuracy": "SELECT 0.5::DOUBLE AS accuracy",
    "sample_programs": """
        SELECT 'def add(a, b):' || chr(10) || '    return a + b' || chr(10) || chr(10) || 'def check(candidate):' || chr(10) || '    assert candidate(1, 2) == 3' || chr(10) || chr(10) || chr(10) || 'check(add)' || chr(10) AS program""",
    "generation_ends": """
        SELECT conv_id AS "group", CAST(sample AS INTEGER) AS sample, '' AS text, 1 AS n_new, true AS terminated
        FROM (SELECT DISTINCT conv_id FROM conversations) c, (SELECT unnest([0, 1]) AS sample) s""",
    "orthogonalized_update": """
        WITH b AS (SELECT vec_id // 48 AS block, least(count(*), 64) AS n FROM embeddings GROUP BY 1)
        SELECT block, CAST(unnest(range(n)) AS INTEGER) AS i, true AS near_one FROM b""",
    "tokenizer_round_trip": "SELECT conv_id, turn, true AS same FROM conversations",
    "sample_pass_rate": "SELECT 0.25::DOUBLE AS pass_rate",
}
