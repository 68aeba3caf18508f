"""Training: pretraining, SFT and GRPO, each update from gradients taken in Spark; checkpoints."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import rewards
from lexispark.functions.bpe import BpeTokenizer
from lexispark.functions.schedule import ModelConfig
from lexispark.model import generation
from lexispark.model.gradients import distributed_gradients, gradient_sums
from lexispark.model.optim import Optimizer, clip, scheduler
from lexispark.model.providers import Transformer
from lexispark.model.transformer import Params, backward, forward, log_softmax, loss_sums
from lexispark.operators.order import with_row_index
from lexispark.session import store


class Run:
    """A training run's whole state: parameters, optimiser, schedule, and the sampler's place."""

    def __init__(self, c: ModelConfig, params: Params, steps: int | None = None):
        self.c, self.params = c, params
        self.optimizer = Optimizer(c, params)
        self.cursor = 0  # the next micro-batch of fine-tuning
        self.schedule = scheduler(c, self.optimizer, steps)

    def update(self, grads: Params) -> float:
        grads, size = clip(grads, self.c.grad_clip)
        self.optimizer.step(self.params, grads, self.schedule.rates())
        self.schedule.step()
        return size


def train(run: Run, sampler, steps: int, *, val_rows: DataFrame | None = None, eval_every: int = 0, on_step=None) -> list[float]:
    """Pretrain for ``steps``: windows of the sampler, one distributed gradient a step.

    Validation uses fixed rows, so evaluations of a run can be compared.
    """
    losses = []
    for _ in range(steps):
        rows = sampler.next_batch(run.c.micro_batch * run.c.grad_accum).select("inputs", "targets")
        loss, grads = distributed_gradients(rows, run.params, run.c)
        run.update(grads)
        losses.append(loss)
        at = run.schedule.last_step
        if on_step:
            on_step(at, loss, validation_loss(val_rows, run) if val_rows is not None and eval_every and at % eval_every == 0 else None)
    return losses


def validation_loss(rows: DataFrame, run: Run) -> float:
    """Mean loss over fixed rows of (inputs, targets)."""
    shared = rows.sparkSession.sparkContext.broadcast(run.params)
    c = run.c

    def score(batches):
        for batch in batches:
            sums = [loss_sums(shared.value, c, np.array([x]), np.array([y]), grad=False)[:2] for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"loss": [s[0] for s in sums], "n": [s[1] for s in sums]}, schema=pa.schema([("loss", pa.float64()), ("n", pa.int64())]))

    row = rows.select("inputs", "targets").mapInArrow(score, "loss double, n bigint").agg(F.sum("loss"), F.sum("n")).first()
    return row[0] / max(1, row[1])


def microbatch_rows(packed: DataFrame, first: int, count: int, batches: int, size: int) -> DataFrame:
    """Rows of ``count`` consecutive micro-batches from ``first`` on, taken round, with ``microbatch``.

    Rows are found by number: the conditions are ranges, which Parquet's statistics answer.
    """
    row = F.col("row")
    if count < batches:
        last = (first + count - 1) % batches
        low, high = row >= first * size, row < (last + 1) * size
        packed = packed.where(low & high if first <= last else low | high)
    return packed.withColumn("microbatch", F.expr(f"row div {size}"))


def sft_step(run: Run, packed: DataFrame, batches: int, *, tasks: int | None = None) -> float:
    """One update from the next ``grad_accum`` micro-batches: the mean of their mean losses.

    A micro-batch's mean is over its own supervised targets, so each row weighs in with its
    micro-batch's share; these weights, one for each micro-batch of the step, are all that the driver sees.
    """
    accum, size = run.c.grad_accum, run.c.micro_batch
    first = run.cursor % batches
    times = Counter((first + i) % batches for i in range(accum))
    rows = microbatch_rows(packed, first, accum, batches, size)
    counted = rows.groupBy("microbatch").agg(F.sum(F.size(F.filter("loss_mask", lambda m: m != 0))).alias("n")).collect()
    weights = [(r["microbatch"], times[r["microbatch"]] / (accum * max(1, r["n"]))) for r in counted]
    weighed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(weights, "microbatch bigint, weight double")), "microbatch")
    named = weighed.select(F.col("input_ids").alias("inputs"), "targets", F.col("loss_mask").alias("mask"), F.col("segment_ids").alias("segments"), "weight")
    loss, grads = distributed_gradients(named, run.params, run.c, tasks=tasks)
    run.update(grads)
    run.cursor += accum
    return loss


def train_sft(run: Run, packed: DataFrame, steps: int, *, tasks: int | None = None) -> list[float]:
    """Fine-tune on packed rows (numbered from 0 without gaps), taken round in micro-batches; the loss
    sees assistant tokens.

    The packed table is written once, ordered by row number; a step reads its rows from there, and
    their gradients are added up in Spark. ``run.cursor`` is where the next step goes on, also after
    a checkpoint.
    """
    stored = store(packed.select("row", "input_ids", "targets", "loss_mask", "segment_ids").repartitionByRange("row").sortWithinPartitions("row"), "packed")
    n = stored.count()
    if not n:
        raise ValueError("no packed rows to train on")
    return [sft_step(run, stored, -(-n // run.c.micro_batch), tasks=tasks) for _ in range(steps)]


def group_advantages(rewards: np.ndarray, groups: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """(r - mean) / (population deviation + eps) per group; 0 in a constant one."""
    out = np.zeros(len(rewards))
    for g in np.unique(groups):
        own = groups == g
        r = rewards[own]
        if r.max() > r.min():
            out[own] = (r - r.mean()) / (r.std() + eps)
    return out


def grpo_sums(params: Params, c: ModelConfig, seqs, mask, advantages, old_logp=None, clip_eps: float = 0.2) -> tuple[float, float, Params]:
    """(sum of the clipped surrogate over completion tokens, their number, gradients of the sum).

    Without ``old_logp`` the parameters are the ones that sampled.
    """
    logits, tape = forward(params, c, seqs)
    logp = log_softmax(logits[:, :-1])
    tgt, m = seqs[:, 1:, None], mask[:, 1:].astype(float)
    own = np.take_along_axis(logp, tgt, -1)[..., 0]
    ratio, adv = np.exp(own - (own if old_logp is None else old_logp)), advantages[:, None]
    free, bound = ratio * adv, np.clip(ratio, 1 - clip_eps, 1 + clip_eps) * adv
    d_own = -(np.where(free <= bound, free, 0.0) * m)  # d ratio / d logp = ratio; a clipped term is flat
    dlogits = np.zeros_like(logits)
    d = -np.exp(logp) * d_own[..., None]
    np.put_along_axis(d, tgt, np.take_along_axis(d, tgt, -1) + d_own[..., None], -1)
    dlogits[:, :-1] = d
    return -float((np.minimum(free, bound) * m).sum()), float(m.sum()), backward(params, c, tape, dlogits)


def grpo_loss(params: Params, c: ModelConfig, seqs, mask, advantages, old_logp, clip_eps: float = 0.2) -> tuple[float, Params]:
    """Clipped surrogate over completion tokens and its gradients."""
    total, n, grads = grpo_sums(params, c, seqs, mask, advantages, old_logp, clip_eps)
    n = max(1.0, n)
    return total / n, {k: g / n for k, g in grads.items()}


def padded(sequences: list[list[int]], prompt_len: list[int], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as a matrix, and a mask that is 1 on what follows the prompts."""
    seqs = np.full((len(sequences), max(map(len, sequences))), pad)
    mask = np.zeros_like(seqs)
    for i, (tokens, start) in enumerate(zip(sequences, prompt_len, strict=True)):
        seqs[i, : len(tokens)] = tokens
        mask[i, start : len(tokens)] = 1
    return seqs, mask


def grpo_gradients(rows: DataFrame, params: Params, c: ModelConfig, *, pad: int, clip_eps: float = 0.2, tasks: int | None = None) -> tuple[float, Params]:
    """Surrogate and gradients over rows of tokens, prompt_len and advantage, sampled by ``params``."""

    def sums(now: Params, part: dict[str, pa.Array]) -> tuple[float, float, Params]:
        tokens, start, advantage = (part[n].to_pylist() for n in ("tokens", "prompt_len", "advantage"))
        return grpo_sums(now, c, *padded(tokens, start, pad), np.array(advantage), clip_eps=clip_eps)

    total, n, grads = gradient_sums(rows.select("tokens", "prompt_len", "advantage"), params, sums, tasks=tasks)
    n = max(1.0, n)
    return total / n, {k: g / n for k, g in grads.items()}


def numbered_bank(bank: DataFrame) -> DataFrame:
    """(number, messages, gold) of a bank of questions, numbered from 0 in order of question and gold; a bank
    that has ``messages`` is numbered in its own order of ``number``."""
    if "messages" not in bank.columns:
        asked = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
        bank = with_row_index(bank.select("question", "gold"), ["question", "gold"], "number").withColumn("messages", asked)
    return store(bank.select(F.col("number").cast("bigint").alias("number"), "messages", F.col("gold").cast("bigint").alias("gold")).repartitionByRange("number"), "bank")


def run_grpo(spark: SparkSession, run: Run, tokenizer: BpeTokenizer, bank: DataFrame | list[tuple[list[dict], int]], *, steps: int, group_size: int = 8, prompts_per_step: int = 4, max_new: int = 16, temperature: float = 1.0, top_k: int | None = 40, lr: float = 1e-4, clip_eps: float = 0.2, seed: int = 0, reward=None, tasks: int | None = None) -> list[float]:
    """Roll out, score, normalise in groups and take gradients in Spark, one clipped update a step;
    mean rewards.

    ``bank`` is a table (question, gold), or a list of (messages, gold); a step's prompts are found by number,
    and only they come to the driver. ``reward`` is a Column function of (text, gold, terminated, n_new,
    max_new), by default the rewards of ``functions.rewards``. A run continues at ``run.cursor``.
    """
    if isinstance(bank, list):
        bank = spark.createDataFrame([(i, m, gold) for i, (m, gold) in enumerate(bank)], "number bigint, messages array<struct<role: string, content: string>>, gold bigint")
    stored = numbered_bank(bank)
    n = stored.count()
    if not n:
        raise ValueError("no prompts to train on")
    reward = reward or rewards.reward
    means = []
    for _ in range(steps):
        step = run.cursor
        numbers = [(step * prompts_per_step + j) % n for j in range(prompts_per_step)]
        found = {r["number"]: r for r in stored.where(F.col("number").isin(numbers)).collect()}
        picked = [(g, generation.rendered([m.asDict() for m in found[i]["messages"]], tokenizer, prompt=True)[0], found[i]["gold"]) for g, i in enumerate(numbers)]
        prompts = spark.createDataFrame(picked, "group bigint, ids array<int>, gold bigint")
        out = generation.sample_groups(prompts, Transformer(run.params, run.c), tokenizer, group_size=group_size, max_new=max_new, temperature=temperature, top_k=top_k, seed=seed + 1000 * step)
        scored = out.join(F.broadcast(prompts.select("group", "gold")), "group").withColumn("reward", reward(F.col("text"), F.col("gold"), F.col("terminated"), F.col("n_new"), F.lit(max_new)))
        rolled = store(scored.withColumn("advantage", rewards.group_advantage(F.col("reward"), "group")).select("tokens", "prompt_len", "reward", "advantage"), "rollouts")
        _, grads = grpo_gradients(rolled, run.params, run.c, pad=tokenizer.pad_id, clip_eps=clip_eps, tasks=tasks)
        grads, _ = clip(grads, run.c.grad_clip)
        run.optimizer.step(run.params, grads, {"hidden": lr, "misc": lr})
        run.cursor += 1
        means.append(float(rolled.agg(F.avg("reward")).first()[0]))
    return means


# --- checkpoints -------------------------------------------------------------------------

_TENSORS = "kind string, name string, shape array<int>, data binary"


def write_tensors(spark: SparkSession, path: str, groups: dict[str, Params]) -> None:
    """Named tensors of each kind, a row each."""
    rows = [(kind, name, list(x.shape), np.ascontiguousarray(x, dtype="<f8").tobytes()) for kind, values in groups.items() for name, x in values.items()]
    spark.createDataFrame(rows, _TENSORS).write.mode("overwrite").parquet(path)


def save_checkpoint(spark: SparkSession, path: str, run: Run, *, sampler=None, extra: dict | None = None, weights_only: bool = False) -> None:
    """A folder with a tensor table and a JSON record, at any path that Spark can write."""
    state = run.optimizer.state()
    groups = {"param": run.params} if weights_only else {"param": run.params, "first": state["first"], "second": state["second"]}
    write_tensors(spark, f"{path}/tensors", groups)
    record = {"config": asdict(run.c), "steps": state["steps"], "schedule": run.schedule.state(), "cursor": run.cursor, "sampler": sampler.state() if sampler else None, "extra": extra or {}}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")


def read_tensors(spark: SparkSession, path: str) -> dict[str, Params]:
    """What ``write_tensors`` wrote, by kind and name."""
    out: dict[str, Params] = {}
    for r in spark.read.schema(_TENSORS).parquet(path).collect():
        out.setdefault(r["kind"], {})[r["name"]] = np.frombuffer(bytes(r["data"]), "<f8").reshape(r["shape"]).copy()
    return out


def load_weights(spark: SparkSession, path: str, params: Params) -> None:
    """Replace parameters by a checkpoint's; names and shapes must match."""
    found = read_tensors(spark, f"{path}/tensors")["param"]
    if found.keys() != params.keys() or any(found[k].shape != v.shape for k, v in params.items()):
        raise ValueError("the checkpoint belongs to another model")
    params.update(found)


def load_checkpoint(spark: SparkSession, path: str, run: Run, *, sampler=None) -> dict:
    """Restore a run (and its sampler) in place; returns the record."""
    load_weights(spark, path, run.params)
    found = read_tensors(spark, f"{path}/tensors")
    record = json.loads(spark.read.text(f"{path}/record").first()[0])
    run.optimizer.load_state({"steps": record["steps"], "first": found.get("first", {}), "second": found.get("second", {})})
    run.schedule.load_state(record["schedule"])
    run.cursor = record.get("cursor", 0)
    if sampler and record["sampler"]:
        sampler.load_state(record["sampler"])
    return record
