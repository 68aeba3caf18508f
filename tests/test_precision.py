"""Passes in single precision, sums in double, and the windows that ``transformer_loss`` runs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import schedule, vocab
from lexispark.model import gradients
from lexispark.model import transformer as T
from lexispark.operators import chat
from lexispark.plans import models

C = schedule.get_config("nano", vocab_size=384, d_model=16, n_layers=2, n_q_heads=4, n_kv_heads=2, head_dim=4, mlp_hidden=24, context=80, window=5, micro_batch=2, grad_accum=1)


def single(p):
    return {k: v.astype(np.float32) for k, v in p.items()}


def arrays(x):
    if isinstance(x, np.ndarray):
        yield x
    elif isinstance(x, dict | list | tuple):
        for y in x.values() if isinstance(x, dict) else x:
            yield from arrays(y)


@pytest.mark.parametrize("factor", [1.0, 8.0, 400.0])
@pytest.mark.parametrize("qk_norm", [True, False])
def test_passes_run_in_the_precision_of_the_parameters(qk_norm, factor):
    """Factors from where no exponent needs its maximum to where exp would overflow."""
    c, rng = schedule.replace(C, qk_norm=qk_norm), np.random.default_rng(1)
    p = {k: v * (1 + 0.1 * rng.normal(size=v.shape)) * (factor if k.endswith(("embed", "_norm")) else 1.0) for k, v in T.init_params(c).items()}
    ids = rng.integers(0, 384, (3, 71))
    part = ids[:, :-1], ids[:, 1:], rng.integers(0, 2, (3, 70)), np.sort(rng.integers(0, 3, (3, 70)), axis=1)
    weights = rng.random(3)
    got, n, grads = T.loss_sums(single(p), c, *part, weights=weights)
    want, m, exact = T.loss_sums({k: v.astype(float) for k, v in single(p).items()}, c, *part, weights=weights)
    assert n == m and got == pytest.approx(want, rel=1e-6 if factor < 100 else 1e-3)
    assert {g.dtype.name for g in grads.values()} == {"float32"} and all(np.isfinite(g).all() for g in grads.values())
    assert {a.dtype.name for a in arrays(T._layers(single(p), c, part[0], part[3])) if a.dtype.kind == "f"} == {"float32"}
    if factor == 1.0:
        assert all(np.abs(grads[k] - g).max() < 1e-5 * max(1.0, np.abs(g).max()) for k, g in exact.items())


def test_steps_are_summed_in_double(spark):
    """1e8 + 1 is 1e8 in single precision."""
    sums = lambda p, rows: (0.0, 1.0, {"x": rows["v"].to_numpy(zero_copy_only=False).astype(np.float32)})
    rows = spark.createDataFrame([(1e8,)] + [(1.0,)] * 8, "v double").coalesce(1)
    for options in ({"tasks": 1}, {"dealt": 1}):
        assert gradients.gradient_sums(rows, {"x": np.zeros(1, np.float32)}, sums, at_a_time=1, **options)[2]["x"].tolist() == [1e8 + 8]


def test_rows_in_more_partitions_than_said_are_all_summed(spark):
    sums = lambda p, rows: (1.0, 1.0, {"x": rows["v"].to_numpy(zero_copy_only=False).repeat(5)})
    rows = spark.range(9, numPartitions=9).selectExpr("cast(id as double) AS v")
    loss, n, grads = gradients.gradient_sums(rows, {"x": np.zeros(5)}, sums, dealt=3, fan_in=3, size=2, at_a_time=1)
    assert (loss, n) == (9.0, 9.0) and grads["x"].tolist() == [36.0] * 5


def plain_windows(turns, size):
    """By ``render`` and ``windows_of``, one token at a time."""
    rows = chat.render(turns).select(F.explode(models.windows_of(F.col("tokens"), size)).alias("t")).collect()
    fill = lambda x, pad: (*x, *[pad] * (size + 1 - len(x)))
    found = [(fill([t.id for t in w], vocab.PAD), fill([t.mask for t in w], 0)) for (w,) in rows]
    return [(ids[:-1], ids[1:], mask[1:]) for ids, mask in found if any(mask[1:])]


@pytest.mark.parametrize("size", [1, 3, 4, 64])
def test_windows_are_those_of_the_rendering(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "WINDOWS_AT_A_TIME", 3)
    rows = [
        (1, 1, "assistant", "b é 你好"), (1, 0, "user", "a" * 9), (1, 2, "user", None), (1, 3, "assistant", None), (1, 4, "assistant", ""),
        (2, 0, "user", "never supervised, so never run"), (3, 0, "assistant", "x"), (4, 0, "system", "s" * 200), (4, 1, "tool", "t"), (4, 2, "assistant", "y" * 130),
        (5, 7, "assistant", "zz"), (5, 7, "assistant", "\n"), (5, 7, "assistant", "zzz"), (5, 7, "user", "u"), (5, None, "assistant", "n"), (5, None, "user", "m"),
        *[(10 + i, 0, "assistant", "w" * i) for i in range(9)],
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(map(tuple, r)) for r in chat.supervised_windows(turns, size, 3).collect()]
    assert got and sorted(got) == sorted(plain_windows(turns, size))


def test_windows_of_an_unknown_role_fail(spark):
    turns = spark.createDataFrame([(1, 0, "judge", "a")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="unknown role judge"):
        chat.supervised_windows(turns, 4, 2).collect()


def test_transformer_loss_is_single_and_equals_double(spark, sf_dir, monkeypatch):
    real, seen = models.training.distributed_gradients, []

    def both(rows, params, c, **options):
        seen.extend(v.dtype.name for v in params.values())
        x, y, m = (np.array([list(r[i]) for r in rows.select("inputs", "targets", "mask").collect()]) for i in range(3))
        loss, grads = T.loss_and_grads(T.init_params(c), c, x, y, m)
        seen.append((round(loss, 6), round(float(np.sqrt(sum((g * g).sum() for g in grads.values()))), 6)))
        return real(rows, params, c, **options)

    monkeypatch.setattr(models.training, "distributed_gradients", both)
    row = models.transformer_loss(spark, sf_dir).first()
    assert set(seen[:-1]) == {"float32"} and tuple(row) == seen[-1]
