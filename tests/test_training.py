"""Gradients in a tree, fine-tuning and policy steps taken in Spark."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import bpe, schedule
from lexispark.model import generation, gradients, providers, training
from lexispark.model import transformer as T
from lexispark.operators import chat
from lexispark.sources import tasks

TINY = schedule.get_config("nano", vocab_size=384, d_model=16, n_layers=1, n_q_heads=2, n_kv_heads=1, head_dim=8, mlp_hidden=16, context=40, window=16, micro_batch=3, grad_accum=2, warmup_steps=2, max_steps=30)


def windows(spark, n, seed=1, length=10):
    ids = np.random.default_rng(seed).integers(0, 384, (n, length + 1))
    return ids, spark.createDataFrame([(r[:-1].tolist(), r[1:].tolist()) for r in ids], "inputs array<int>, targets array<int>")


@pytest.mark.parametrize(("tasks_", "fan_in", "size"), [(200, 4, 1000), (7, 2, 17), (1, 16, 1 << 16)])
def test_tree_equals_the_local_sums(spark, tasks_, fan_in, size):
    """Groups of more than ``fan_in`` parts raise, so a green run proves the bound."""
    params = T.init_params(TINY)
    ids, rows = windows(spark, 90)
    loss, grads = gradients.distributed_gradients(rows, params, TINY, tasks=tasks_, fan_in=fan_in, size=size)
    want_loss, want = T.loss_and_grads(params, TINY, ids[:, :-1], ids[:, 1:])
    assert loss == pytest.approx(want_loss) and grads.keys() == want.keys()
    assert all(np.allclose(grads[k], want[k]) and grads[k].shape == want[k].shape for k in want)


def test_fan_in_is_bounded(spark):
    assert [gradients.levels(n, 16) for n in (1, 2, 16, 17, 256, 257, 4096)] == [0, 1, 1, 2, 2, 3, 3]
    parts = spark.createDataFrame([("a", 0, i, np.array([float(i), 1.0]).tobytes()) for i in range(200)], "name string, slice int, part int, data binary")
    (row,) = gradients.tree_sum(parts, 200, 6).collect()
    assert np.frombuffer(bytes(row.data)).tolist() == [19900.0, 200.0]
    with pytest.raises(Exception, match="parts of a in one group"):
        gradients.tree_sum(parts.withColumn("part", F.lit(0)), 200, 6).collect()


def test_slices_cover_a_tensor():
    x = np.arange(10.0).reshape(2, 5)
    rows = list(gradients.sliced("x", x, 3, size=4))
    assert [(r["slice"], r["part"], len(r["data"]) // 8) for r in rows] == [(0, 3, 4), (1, 3, 4), (2, 3, 2)]
    assert np.concatenate([np.frombuffer(r["data"]) for r in rows]).tolist() == x.ravel().tolist()


def packed_rows(spark, n=14):
    return chat.pack_conversations(chat.render_messages(tasks.synthetic_conversations(spark, n)), TINY.context)


def driver_loop(run, packed, steps, cursor=0):
    """Fine-tuning with all rows in memory: the mean of the micro-batches' means."""
    x, y, mask, seg = (chat.to_matrix(packed, n) for n in ("input_ids", "targets", "loss_mask", "segment_ids"))
    batches = [slice(a, a + run.c.micro_batch) for a in range(0, len(x), run.c.micro_batch)]
    losses = []
    for _ in range(steps):
        parts = []
        for _ in range(run.c.grad_accum):
            at = batches[cursor % len(batches)]
            cursor += 1
            parts.append(T.loss_and_grads(run.params, run.c, x[at], y[at], mask[at], seg[at]))
        run.update({k: sum(g[k] for _, g in parts) / len(parts) for k in parts[0][1]})
        losses.append(sum(loss for loss, _ in parts) / len(parts))
    return losses


@pytest.mark.parametrize("accum", [1, 2, 7])
def test_fine_tuning_is_the_driver_loop(spark, accum):
    c = schedule.replace(TINY, grad_accum=accum)
    packed = packed_rows(spark).cache()
    assert packed.count() > 2 * c.micro_batch and packed.count() % c.micro_batch
    here, there = training.Run(c, T.init_params(c), 20), training.Run(c, T.init_params(c), 20)
    assert training.train_sft(here, packed, 4, tasks=3) == pytest.approx(driver_loop(there, packed, 4))
    assert all(np.allclose(here.params[k], there.params[k]) for k in here.params)
    assert here.cursor == 4 * accum


def test_restart_within_an_epoch_is_exact(spark, tmp_path):
    packed = packed_rows(spark).cache()
    whole = training.Run(TINY, T.init_params(TINY), 20)
    losses = training.train_sft(whole, packed, 4)
    half = training.Run(TINY, T.init_params(TINY), 20)
    first = training.train_sft(half, packed, 2)
    assert half.cursor % -(-packed.count() // TINY.micro_batch)  # not at an epoch's end
    training.save_checkpoint(spark, str(tmp_path / "ck"), half)
    again = training.Run(TINY, T.init_params(TINY, seed=9), 20)
    training.load_checkpoint(spark, str(tmp_path / "ck"), again)
    assert again.cursor == half.cursor
    assert first + training.train_sft(again, packed, 2) == pytest.approx(losses)
    assert all(np.allclose(again.params[k], whole.params[k]) for k in whole.params)


def test_a_step_reads_its_rows_by_number(spark):
    rows = spark.range(20).select(F.col("id").alias("row"))
    read = lambda first, count: sorted((r.row, r.microbatch) for r in training.microbatch_rows(rows, first, count, 7, 3).collect())
    assert read(1, 2) == [(i, i // 3) for i in range(3, 9)]
    assert read(6, 2) == [(i, i // 3) for i in [0, 1, 2, 18, 19]]  # the last is short, then round again
    assert len(read(3, 7)) == len(read(0, 30)) == 20
    plan = training.microbatch_rows(rows, 1, 2, 7, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and ">= 3" in plan and "< 9" in plan


def test_policy_gradients_are_the_local_ones(spark):
    params, rng = T.init_params(TINY), np.random.default_rng(3)
    rows = [(rng.integers(0, 384, n).tolist(), 2, float(rng.normal())) for n in (5, 9, 7, 6, 9)]
    seqs, mask = training.padded([r[0] for r in rows], [2] * 5, 0)
    adv = np.array([r[2] for r in rows])
    old, _ = generation.token_logprobs(providers.Transformer(params, TINY), seqs, mask)
    want_loss, want = training.grpo_loss(params, TINY, seqs, mask, adv, old)
    table = spark.createDataFrame(rows, "tokens array<int>, prompt_len int, advantage double")
    loss, grads = training.grpo_gradients(table, params, TINY, pad=0, tasks=3)
    assert loss == pytest.approx(want_loss) and all(np.allclose(grads[k], want[k]) for k in want)


def test_policy_steps_draw_prompts_from_a_table(spark):
    coder = bpe.BpeTokenizer(bpe.base_tokens(), [])
    bank = tasks.arithmetic_bank(spark, 5, seed=2)
    numbered = training.numbered_bank(bank).orderBy("number").collect()
    assert [r.number for r in numbered] == list(range(5)) and numbered[0].messages[0].role == "user"
    run = training.Run(TINY, T.init_params(TINY), 4)
    before = run.params["layer0.q"].copy()
    means = training.run_grpo(spark, run, coder, bank, steps=2, group_size=3, prompts_per_step=2, max_new=3, reward=lambda text, gold, ended, n, limit: F.length(text).cast("double"))
    assert len(means) == 2 and run.cursor == 2 and not np.array_equal(before, run.params["layer0.q"])
    with pytest.raises(ValueError, match="no prompts"):
        training.run_grpo(spark, run, coder, bank.limit(0), steps=1)
