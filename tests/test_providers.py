"""Scoring without logits, and generation from kept keys and values."""

from __future__ import annotations

import numpy as np
import pytest

from lexispark.functions import bpe, schedule
from lexispark.model import evaluation, generation, providers
from lexispark.model import transformer as T
from lexispark.sources import tasks

C = schedule.get_config("nano", vocab_size=384, d_model=16, n_layers=3, n_q_heads=4, n_kv_heads=2, head_dim=4, mlp_hidden=24, context=24, window=5, full_attn_every=2)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    return providers.Transformer({k: v + 0.3 * rng.normal(size=v.shape) for k, v in T.init_params(C).items()}, C)


def plain(model):
    """The same provider as a function: whole contexts in, logits out."""
    return lambda ids: model(ids)


def all_providers(model):
    rng = np.random.default_rng(1)
    return [model, providers.Uniform(384), providers.Preferred(384, [5, 7, 2]), providers.Bigram(rng.integers(0, 9, (384, 384)).astype(float))]


@pytest.mark.parametrize("tile", [1, 50, 1 << 20])
def test_target_logprobs_are_those_of_the_logits(model, monkeypatch, tile):
    monkeypatch.setattr(providers, "TILE", tile)
    monkeypatch.setattr(providers.log_sum_exp, "__defaults__", (tile,))
    ids = np.random.default_rng(2).integers(0, 384, (3, 9))
    for provider in all_providers(model):
        x, y = ids[:, :-1], ids[:, 1:]
        want = np.take_along_axis(T.log_softmax(np.asarray(provider(x), dtype=float)), y[..., None], -1)[..., 0]
        assert np.allclose(providers.target_logprobs(provider, x, y), want)
        assert np.allclose(providers.target_logprobs(lambda i, p=provider: p(i), x, y), want)


def test_log_sum_exp_of_large_values():
    h, w = np.array([[1000.0], [-1000.0], [0.0]]), np.array([[1.0], [0.5], [-1.0], [1.0]])
    want = [1000 + np.log(2), 1000.0, np.log(4)]
    for tile in (1, 2, 5, 100):
        assert np.allclose(providers.log_sum_exp(h, w, tile), want)


def test_perplexity_of_mixed_windows(spark, model):
    rng = np.random.default_rng(3)
    rows = [(rng.integers(0, 384, n).tolist(),) for n in (2, 9, 9, 1, 0, 5, 24, 9)] + [(None,)]
    windows = spark.createDataFrame(rows, "tokens array<int>").repartition(3)
    logs = [np.take_along_axis(T.log_softmax(model(np.array([x]))[:, :-1]), np.array([x])[:, 1:, None], -1).ravel() for (x,) in rows if x and len(x) > 1]
    assert evaluation.perplexity(windows, model).first()[0] == pytest.approx(np.exp(-np.concatenate(logs).mean()))
    assert evaluation.perplexity(windows.limit(0), model).first()[0] == 1.0


def test_extended_states_are_the_forward_ones(model):
    ids = np.random.default_rng(4).integers(0, 384, (2, 20))
    want = T.forward(model.params, C, ids)[0]
    for cuts in ([20], [1] * 20, [7, 1, 1, 11]):
        cache, at, got = T.Cache(C, 2, 20), 0, []
        for n in cuts:
            got.append(T.extend(model.params, C, cache, ids[:, at : at + n]) @ model.params["embed"].T)
            at += n
        assert np.allclose(np.concatenate(got, axis=1), want) and cache.work == 20


@pytest.mark.parametrize("options", [{}, {"temperature": 0.9, "seed": 5, "top_k": 30}, {"eos": 3, "temperature": 1.5, "seed": 1}, {"context": 9}])
def test_cached_generation_gives_the_same_tokens(model, options):
    ids = np.random.default_rng(5).integers(0, 384, (3, 6))
    full = {"context": C.context, **options}
    want = generation.generate(plain(model), ids, max_new=25, **full)  # outgrows the context of 24
    assert generation.generate(model, ids, max_new=25, **options).tolist() == want.tolist()


def test_work_is_linear_in_new_tokens(model, monkeypatch):
    seen = []
    monkeypatch.setattr(providers, "extend", lambda p, c, cache, ids: (seen.append(ids.shape[1]), T.extend(p, c, cache, ids))[1])
    monkeypatch.setattr(providers, "forward", None)
    generation.generate(model, np.ones((2, 5), dtype=int), max_new=19)
    assert seen == [5] + [1] * 18


def test_batched_groups_draw_what_each_draws_alone(spark, model):
    coder = bpe.BpeTokenizer(bpe.base_tokens(), [])
    rng = np.random.default_rng(6)
    prompts = [(g, rng.integers(8, 264, n).tolist()) for g, n in enumerate((3, 5, 3, 4, 3, 5))]
    small = providers.Bigram(rng.integers(0, 9, (264, 264)).astype(float))
    table = spark.createDataFrame(prompts, "group bigint, ids array<int>").coalesce(1)
    got = {(r.group, r.sample): (r.tokens, r.terminated, r.n_new) for r in generation.sample_groups(table, small, coder, group_size=3, max_new=8, top_k=20, seed=4).collect()}
    for g, ids in prompts:
        rows = generation.generate(small, np.array([ids] * 3), max_new=8, temperature=1.0, top_k=20, eos=coder.eos_id, seed=4 + g)[:, len(ids) :].tolist()
        for i, new in enumerate(rows):
            new = new[: new.index(coder.eos_id) + 1] if coder.eos_id in new else new
            assert got[g, i] == (ids + new, bool(new) and new[-1] == coder.eos_id, len(new))
    alone = generation.sample_groups(table, small, coder, group_size=1, max_new=4, seed=4)
    assert alone.count() == 6


def test_programs_are_completed_in_batches(spark):
    coder = bpe.BpeTokenizer(bpe.base_tokens(), [])
    rows = tasks.sample_problems(spark)
    got = evaluation.programs(rows.unionByName(rows), providers.Preferred(264, [coder.encode("z")[0]]), coder, max_new=3).collect()
    assert len(got) == 2 * rows.count() and all("zzz" in r.program for r in got)


def test_sequence_logprobs_of_rows(spark, model):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(0, 384, n).tolist() if n is not None else None) for i, n in enumerate((5, 1, 0, 9, None, 2))]
    table = spark.createDataFrame(rows, "k int, tokens array<int>")
    got = {r.k: (r.n, r.logp) for r in evaluation.sequence_logprobs(table, model, key=["k"]).collect()}
    for k, ids in rows:
        if not ids or len(ids) < 2:
            assert got[k] == (0, 0.0)
        else:
            want = np.take_along_axis(T.log_softmax(model(np.array([ids]))[:, :-1]), np.array([ids])[:, 1:, None], -1).sum()
            assert got[k] == (len(ids) - 1, pytest.approx(want))
