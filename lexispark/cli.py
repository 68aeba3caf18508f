"""Commands: prepare, train, generate, posttrain, evaluate. One function each; all paths are
Spark paths."""

from __future__ import annotations

import argparse
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.bpe import BpeTokenizer
from lexispark.functions.bpe import train as train_bpe
from lexispark.functions.schedule import ModelConfig, get_config
from lexispark.model import evaluation, generation, training
from lexispark.model.providers import Transformer
from lexispark.model.transformer import init_params
from lexispark.operators import chat, packing, scoring
from lexispark.session import build_session, store
from lexispark.sources import corpus, shards, tasks


def prepare(spark: SparkSession, *, source="synthetic", parts_dir: str, parts: int, docs_per_part: int, tokenizer_path: str, data: str, vocab_size: int, min_frequency: int = 2, shard_tokens: int = 50_000_000, val_shards: int = 1, overwrite: bool = False) -> DataFrame:
    """Documents to parts, a trained tokenizer and packed shards; returns the manifest."""
    docs = corpus.resolve_source(spark, source)
    corpus.write_parts(docs, parts_dir, parts=parts, docs_per_part=docs_per_part, overwrite=overwrite)
    texts = corpus.read_parts(spark, parts_dir, parts=parts)
    tokenizer = train_bpe(texts, vocab_size, min_frequency=min_frequency)
    tokenizer.save(spark, tokenizer_path)
    # ids are made and written once; lengths alone go through the prefix sum
    encoded = texts.select((F.col("part") * docs_per_part + F.col("line")).alias("doc_id"), tokenizer.encode_column(F.col("text"), eos=True).alias("ids"))
    encoded = store(encoded, "encoded")
    placed = store(packing.token_offsets(encoded.select("doc_id", F.size("ids").alias("n")), F.col("n"), add_eos=False).drop("n"), "offsets")
    cut = packing.pack(placed, shard_tokens, val_shards)
    if not cut.take(1):
        raise ValueError("the corpus has no tokens")
    record = packing.manifest(cut, tokenizer.fingerprint(), tokenizer.vocab_size)
    shards.write_corpus(packing.shard_tokens_table(placed.join(encoded, "doc_id"), shard_tokens), cut, record, data)
    return shards.load_manifest(spark, data)


def open_corpus(spark: SparkSession, data: str, tokenizer: BpeTokenizer, c: ModelConfig) -> tuple[DataFrame, DataFrame]:
    """(shards, pieces) of a packed corpus that fits tokenizer and model."""
    record = shards.load_manifest(spark, data)
    shards.require_tokenizer(record, tokenizer.fingerprint(), c.vocab_size)
    listed = record.select(F.explode("shards").alias("s")).select(F.regexp_extract("s.name", r"(\d+)", 1).cast("bigint").alias("shard"), "s.tokens", "s.split")
    return listed, shards.read_tokens(spark, data)


def train(spark: SparkSession, *, data: str, tokenizer_path: str, c: ModelConfig, steps: int, out: str, resume: str | None = None, eval_every: int = 0) -> list[float]:
    """Pretrain and write a checkpoint; ``resume`` continues one exactly."""
    tokenizer = BpeTokenizer.load(spark, tokenizer_path)
    listed, pieces = open_corpus(spark, data, tokenizer, c)
    sampler = packing.WindowSampler(listed, pieces, context=c.context, seed=c.seed)
    run = training.Run(c, init_params(c))
    if resume:
        training.load_checkpoint(spark, resume, run, sampler=sampler)
    val = None
    if eval_every and listed.where("split = 'val'").take(1):
        val = packing.WindowSampler(listed, pieces, context=c.context, split="val", seed=c.seed).next_batch(16).cache()
    losses = training.train(run, sampler, steps, val_rows=val, eval_every=eval_every, on_step=lambda i, loss, v: print(f"step {i}: loss {loss:.4f}" + (f", validation {v:.4f}" if v is not None else "")))
    training.save_checkpoint(spark, out, run, sampler=sampler)
    return losses


def load_provider(spark: SparkSession, path: str, c: ModelConfig) -> Transformer:
    params = init_params(c)
    training.load_weights(spark, path, params)
    return Transformer(params, c)


def generate(spark: SparkSession, *, checkpoint: str, tokenizer_path: str, c: ModelConfig, prompt: str | None = None, message: str | None = None, max_new: int = 100, temperature: float = 0.0, top_k: int | None = None, seed: int = 0) -> str:
    """Continue a raw prompt, or answer a user message: exactly one of the two."""
    if (prompt is None) == (message is None):
        raise ValueError("give exactly one of prompt and message")
    tokenizer, provider = BpeTokenizer.load(spark, tokenizer_path), load_provider(spark, checkpoint, c)
    options = {"temperature": temperature, "top_k": top_k, "seed": seed}
    if message is not None:
        return generation.reply(provider, tokenizer, [{"role": "user", "content": message}], max_new=max_new, **options)
    ids = np.array([tokenizer.encode(prompt, add_bos=True)])
    return tokenizer.decode(generation.generate(provider, ids, max_new=max_new, eos=tokenizer.eos_id, **options)[0])


def posttrain(spark: SparkSession, *, stage: str, checkpoint: str | None, tokenizer_path: str, c: ModelConfig, out: str, steps: int, conversations: DataFrame | None = None, bank: DataFrame | None = None, resume: str | None = None, seed: int = 0) -> list[float]:
    """``sft`` on conversations (conv_id, messages), or ``grpo`` on a bank (question, gold); ``resume`` continues
    a fine-tuning run of the same ``steps`` in all exactly where its checkpoint stands."""
    tokenizer = BpeTokenizer.load(spark, tokenizer_path)
    run = training.Run(c, init_params(c), steps)
    if checkpoint:
        training.load_weights(spark, checkpoint, run.params)
    if resume:
        training.load_checkpoint(spark, resume, run)
    if stage == "sft":
        rows = conversations if conversations is not None else tasks.synthetic_conversations(spark, 256, seed)
        rendered = chat.render_messages(rows, ids=tokenizer.encode_column(F.coalesce("text", F.lit(""))))
        result = training.train_sft(run, chat.pack_conversations(rendered, c.context), steps)
    elif stage == "grpo":
        rows = bank if bank is not None else tasks.arithmetic_bank(spark, 64, seed=seed)
        result = training.run_grpo(spark, run, tokenizer, rows, steps=steps, seed=seed)
    else:
        raise ValueError(f"unknown stage {stage!r}; choose sft or grpo")
    training.save_checkpoint(spark, out, run, extra={"stage": stage, "curve": result}, weights_only=stage == "grpo")
    return result


def evaluate(spark: SparkSession, *, checkpoints: dict[str, str], tokenizer_path: str, c: ModelConfig, data: str | None = None, task_specs: dict[str, str] | None = None, n_windows: int = 256, limit: int | None = None, allow_execution: bool = False) -> DataFrame:
    """(checkpoint, metric, value) rows; all checkpoints see the same validation windows."""
    tokenizer = BpeTokenizer.load(spark, tokenizer_path)
    windows = None
    if data:
        listed, pieces = open_corpus(spark, data, tokenizer, c)
        windows = packing.WindowSampler(listed, pieces, context=c.context, split="val").next_batch(n_windows).cache()
    sets = {m: tasks.resolve_tasks(spark, s, m, limit) for m, s in (task_specs or {}).items()}
    sets = {m: (t.withColumn("q_id", F.monotonically_increasing_id()) if m != "humaneval" and t is not None and "q_id" not in t.columns else t) for m, t in sets.items()}
    found = None
    for name, path in checkpoints.items():
        rows = evaluation.evaluate(load_provider(spark, path, c), tokenizer, windows=windows, allow_execution=allow_execution, **sets)
        if rows is not None:
            rows = rows.select(F.lit(name).alias("checkpoint"), "metric", "value")
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("nothing to evaluate")
    return found


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="lexispark")
    ap.add_argument("command", choices=["prepare", "train", "generate", "posttrain", "evaluate"])
    ap.add_argument("--tier", default="mini")
    ap.add_argument("--override", default="{}", help="model settings as a JSON object")
    ap.add_argument("--options", required=True, help="the command's arguments as a JSON object")
    args = ap.parse_args(argv)
    spark = build_session("lexispark")
    options = json.loads(args.options)
    if args.command != "prepare":
        options["c"] = get_config(args.tier, **json.loads(args.override))
    result = globals()[args.command](spark, **options)
    if args.command == "evaluate":
        print(scoring.report(result))
    elif isinstance(result, DataFrame):
        result.show(truncate=False)
    else:
        print(result)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
