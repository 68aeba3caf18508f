from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import arrays, bpe, rewards, schedule
from lexispark.model import evaluation, generation, optim, providers, training
from lexispark.model import transformer as T
from lexispark.operators import chat, scoring
from lexispark.sources import tasks

TINY = schedule.get_config("nano", vocab_size=384, d_model=16, n_layers=2, n_q_heads=4, n_kv_heads=2, head_dim=4, mlp_hidden=24, context=16, window=4, micro_batch=2, grad_accum=1, lr_adamw=1e-2, warmup_steps=2, max_steps=30)


@pytest.fixture
def params():
    rng = np.random.default_rng(0)
    return {k: v + 0.1 * rng.normal(size=v.shape) for k, v in T.init_params(TINY).items()}


def data(rng, rows=2, length=10):
    ids = rng.integers(0, 384, (rows, length + 1))
    return ids[:, :-1], ids[:, 1:], rng.integers(0, 2, (rows, length)), np.sort(rng.integers(0, 3, (rows, length)), axis=1)


def test_gradients_by_finite_differences(params):
    rng = np.random.default_rng(1)
    x, y, mask, seg = data(rng)
    _, grads = T.loss_and_grads(params, TINY, x, y, mask, seg)
    assert grads.keys() == params.keys()
    for name, p in params.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in p.shape) if name != "embed" else (rng.choice(np.r_[x.ravel(), y.ravel()]), rng.integers(0, 16))
            old = p[at]
            sides = []
            for step in (1e-5, -1e-5):
                p[at] = old + step
                sides.append(T.loss_and_grads(params, TINY, x, y, mask, seg)[0])
            p[at] = old
            assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-8), name


def test_causality_window_and_segments(params):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 384, (1, 12))
    z = T.forward(params, TINY, x)[0]
    future = x.copy()
    future[0, 8:] = rng.integers(0, 384, 4)
    assert np.allclose(T.forward(params, TINY, future)[0][0, :8], z[0, :8])
    seg = np.array([[0] * 6 + [1] * 6])
    other = x.copy()
    other[0, :6] = rng.integers(0, 384, 6)
    assert np.allclose(T.forward(params, TINY, other, seg)[0][0, 6:], T.forward(params, TINY, x, seg)[0][0, 6:])
    narrow = schedule.replace(TINY, full_attn_every=99)
    far = x.copy()
    far[0, 0] = (far[0, 0] + 1) % 384
    assert np.allclose(T.forward(params, narrow, far)[0][0, 7:], T.forward(params, narrow, x)[0][0, 7:])  # two layers of window 4 reach 6 back


def test_parameter_count_and_groups(params):
    for c in [TINY, *schedule.TIERS.values()]:
        if c.name == "nano" or c is TINY:
            assert T.num_parameters(T.init_params(c)) == c.parameter_counts()["total"]
    groups = {k: optim.parameter_group(k, v) for k, v in params.items()}
    assert groups["embed"] == groups["final_norm"] == "misc" and groups["layer0.q"] == "hidden"


@pytest.mark.parametrize("change", [{"d_model": 100}, {"n_kv_heads": 3}, {"vocab_size": 70_000}, {"vocab_size": 1000}, {"window": 9999}, {"n_layers": 0}])
def test_invalid_configs_fail(change):
    with pytest.raises(ValueError):
        schedule.get_config("nano", **change)


def test_config_presets_and_schedule():
    with pytest.raises(KeyError):
        schedule.get_config("huge")
    assert [c.parameter_counts()["total"] for c in schedule.TIERS.values()] == [12_521_472, 39_331_328, 100_684_032]
    assert [schedule.lr_multiplier(s, 10, 100, 0.1) for s in (0, 9, 55, 100)] == pytest.approx([0.1, 1.0, 0.55, 0.1])
    w = schedule.WarmupCosine({"a": 2.0, "b": 1.0}, 10, 100, 0.1)
    w.step()
    assert w.rates() == pytest.approx({"a": 0.4, "b": 0.2})
    v = schedule.WarmupCosine({}, 10, 100, 0.1)
    v.load_state(w.state())
    assert v.rates() == w.rates()


@pytest.mark.parametrize("chunk", [1, 7, 64, 100_000])
def test_chunked_cross_entropy(chunk):
    rng = np.random.default_rng(3)
    h, w, y = rng.normal(size=(20, 16)), rng.normal(size=(97, 16)), rng.integers(0, 97, 20)
    y[::5] = -100
    loss, dh, dw = T.chunked_cross_entropy(h, w, y, chunk)
    logp, valid = T.log_softmax(h @ w.T), y != -100
    d = np.exp(logp)
    d[valid, y[valid]] -= 1
    d *= valid[:, None] / valid.sum()
    assert loss == pytest.approx(-logp[valid, y[valid]].mean())
    assert np.allclose(dh, d @ w) and np.allclose(dw, d.T @ h)
    assert T.chunked_cross_entropy(h, w, np.full(20, -100), chunk)[0] == 0.0


def test_array_kernels_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=8), rng.normal(size=8)
    df = spark.createDataFrame([(x.tolist(), y.tolist(), 3)], "x array<double>, y array<double>, pos int")
    a, b = F.col("x"), F.col("y")
    got = df.select(
        arrays.rmsnorm(a, b).alias("norm"), arrays.rope(a, F.col("pos")).alias("rope"), arrays.swiglu(a, b).alias("gate"), arrays.log_softmax(a).alias("ls"),
        arrays.softmax(a, 0.5).alias("sm"), arrays.argmax(a).alias("am"), arrays.rmsnorm_dx(a, b).alias("dx"),
    ).first()
    cos, sin = T.rope_angles(4, 8, 10_000.0)
    assert np.allclose(got["norm"], T.norm(x, y)[0]) and np.allclose(got.rope, T.rotate(x, cos[3], sin[3]))
    assert np.allclose(got.gate, x / (1 + np.exp(-x)) * y) and np.allclose(got.ls, T.log_softmax(x)) and np.allclose(got.sm, np.exp(T.log_softmax(x / 0.5)))
    assert got.am == x.argmax() and np.allclose(got.dx, T.norm_back(y, x, T.norm(x, 1.0)[1], np.ones(8))[0])


def test_orthogonalized():
    g = np.random.default_rng(5).normal(size=(12, 5))
    for m in (g, g.T):
        s = np.linalg.svd(optim.orthogonalized(m), compute_uv=False)
        assert ((s > 0.5) & (s < 1.4)).all()


@pytest.mark.parametrize("muon", [True, False])
def test_overfits_one_batch(muon):
    c = schedule.replace(TINY, use_muon=muon)
    run = training.Run(c, T.init_params(c), 40)
    x, y, *_ = data(np.random.default_rng(6))
    losses = []
    for _ in range(40):
        loss, grads = T.loss_and_grads(run.params, c, x, y)
        run.update(grads)
        losses.append(loss)
    assert losses[-1] < 0.6 * losses[0]


def rows_of(spark, x, y):
    return spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "inputs array<int>, targets array<int>")


def test_distributed_gradients_are_the_local_ones(spark, params):
    x, y, *_ = data(np.random.default_rng(7), rows=6)
    loss, grads = training.distributed_gradients(rows_of(spark, x, y).repartition(3), params, TINY)
    want_loss, want = T.loss_and_grads(params, TINY, x, y)
    assert loss == pytest.approx(want_loss)
    assert all(np.allclose(grads[k], want[k]) for k in want)


class Fixed:
    """A sampler of numbered random windows."""

    def __init__(self, spark):
        self.spark, self.position = spark, 0

    def next_batch(self, n):
        x, y, *_ = data(np.random.default_rng(100 + self.position), rows=n)
        self.position += n
        return rows_of(self.spark, x, y)

    def state(self):
        return {"position": self.position}

    def load_state(self, state):
        self.position = state["position"]


def test_resumed_training_is_exact(spark, tmp_path):
    whole, sampler = training.Run(TINY, T.init_params(TINY)), Fixed(spark)
    losses = training.train(whole, sampler, 4)
    half, other = training.Run(TINY, T.init_params(TINY)), Fixed(spark)
    first = training.train(half, other, 2)
    training.save_checkpoint(spark, str(tmp_path / "ck"), half, sampler=other)
    again, place = training.Run(TINY, T.init_params(TINY, seed=9)), Fixed(spark)
    training.load_checkpoint(spark, str(tmp_path / "ck"), again, sampler=place)
    assert first + training.train(again, place, 2) == pytest.approx(losses)
    assert all(np.allclose(again.params[k], whole.params[k]) for k in whole.params)
    with pytest.raises(ValueError, match="another model"):
        training.load_weights(spark, str(tmp_path / "ck"), {"embed": np.zeros((1, 1))})


def test_generation():
    a = np.array([[1, 2]])
    assert generation.generate(providers.Preferred(8, [5]), a, max_new=3).tolist() == [[1, 2, 5, 5, 5]]
    assert generation.generate(providers.Preferred(8, [2]), a, max_new=9, eos=2).tolist() == [[1, 2, 2]]
    seen = []

    def spy(ids):
        seen.append(ids.shape[1])
        return np.zeros((*ids.shape, 8))

    generation.generate(spy, np.zeros((1, 5), int), max_new=4, context=6)
    assert seen == [5, 6, 6, 6]
    draw = lambda seed: generation.generate(providers.Uniform(50), np.zeros((4, 1), int), max_new=12, temperature=1.0, seed=seed).tolist()
    assert draw(1) == draw(1) != draw(2)
    z = np.array([[3.0, 1.0, 2.0, 2.0]])
    picks = {int(generation.next_tokens(z, 1.0, 2, np.random.default_rng(i))[0]) for i in range(200)}
    assert picks == {0, 2, 3}  # the tie at the threshold stays
    coder = bpe.BpeTokenizer(bpe.base_tokens(), [])
    assert generation.reply(providers.Preferred(264, [coder.encode("z")[0]]), coder, [{"role": "user", "content": "hi"}], max_new=3) == "zzz"


def test_perplexity_of_a_uniform_model(spark):
    windows = spark.createDataFrame([([i % 64 for i in range(j, j + 17)],) for j in range(6)], "tokens array<int>")
    assert evaluation.perplexity(windows, providers.Uniform(64)).first()[0] == pytest.approx(64)


def test_multiple_choice(spark):
    coder = bpe.BpeTokenizer(bpe.base_tokens(), [])
    q = spark.createDataFrame([(1, "x", ["", "aaa", "b"], 1), (2, "", ["b", "a"], 1), (3, "x", ["b", "c"], 0)], "q_id bigint, prompt string, choices array<string>, answer int")
    model = providers.Preferred(264, [coder.encode("a")[0]])
    assert evaluation.multiple_choice(q, model, coder).first()[0] == pytest.approx(1.0)
    assert evaluation.multiple_choice(q.limit(0), model, coder).first()[0] == 0.0
    both = evaluation.evaluate(model, coder, mmlu=q).collect()
    assert [r.metric for r in both] == ["mmlu"]


def test_code_problems(spark):
    assert scoring.run_program("assert 1 + 1 == 2") and not scoring.run_program("raise ValueError")
    assert not scoring.run_program("while True: pass", timeout=1.0)
    rows = tasks.sample_problems(spark).withColumn("c", F.explode(F.array(F.lit("return a + b"), F.lit("return a - b"))))
    programs = rows.select(scoring.program(F.col("prompt"), F.col("c"), F.col("test"), F.col("entry_point")).alias("program"))
    assert scoring.pass_rate(programs, allow_execution=True).first()[0] == 0.5
    with pytest.raises(PermissionError):
        scoring.pass_rate(programs)


def test_rewards(spark):
    cases = [("so 72", 72), ("#### -5 then 9", -5), ("1 then 42", 42), ("it is 1,200", 200), ("3-5", -5), ("none", None), ("9" * 30, None), ("", None)]
    df = spark.createDataFrame(cases, "text string, want bigint")
    assert all(r.got == r.want for r in df.select("want", rewards.final_int(F.col("text")).alias("got")).collect())
    r = spark.range(1).select(*[rewards.reward(F.lit(t), F.lit(7), F.lit(True), F.lit(3), F.lit(5)).alias(n) for n, t in (("right", "7"), ("wrong", "8"), ("none", "x"))]).first()
    assert (r.right, r.wrong) == (1.5, 0.5) and r.none == pytest.approx(1 / 3)
    g = spark.createDataFrame([(0, 1.0), (0, 0.0), (1, 0.1), (1, 0.1), (1, 0.1)], "g int, r double")
    adv = sorted((x.g, round(x.a, 4)) for x in g.select("g", rewards.group_advantage(F.col("r"), "g").alias("a")).collect())
    assert adv == [(0, -1.0), (0, 1.0), (1, 0.0), (1, 0.0), (1, 0.0)]
    assert training.group_advantages(np.array([1.0, 0, 2, 2]), np.array([0, 0, 1, 1])).tolist() == pytest.approx([1, -1, 0, 0], abs=1e-4)


def test_grpo_gradient_and_direction(params):
    rng = np.random.default_rng(8)
    seqs, mask, adv = rng.integers(0, 384, (3, 8)), np.zeros((3, 8), int), np.array([1.0, -1.0, 0.5])
    mask[:, 4:] = 1
    old, _ = generation.token_logprobs(providers.Transformer(params, TINY), seqs, mask)
    for shift in (0.0, 0.05):
        loss, grads = training.grpo_loss(params, TINY, seqs, mask, adv, old - shift)
        p = params["layer0.up"]
        numeric = []
        for step in (1e-5, -1e-5):
            p[2, 3] += step
            numeric.append(training.grpo_loss(params, TINY, seqs, mask, adv, old - shift)[0])
            p[2, 3] -= step
        assert grads["layer0.up"][2, 3] == pytest.approx((numeric[0] - numeric[1]) / 2e-5, rel=1e-3, abs=1e-9)
    assert all(np.abs(g).max() == 0 for g in training.grpo_loss(params, TINY, seqs, mask, np.zeros(3), old)[1].values())
    _, far = training.grpo_loss(params, TINY, seqs, mask, np.ones(3), old - 1.0)  # clipped: no gradient
    assert all(np.abs(g).max() == 0 for g in far.values())


def test_sft_loss_falls_and_grpo_runs(spark):
    coder = bpe.BpeTokenizer(bpe.base_tokens(), [])
    c = schedule.replace(TINY, context=40, window=16)
    packed = chat.pack_conversations(chat.render_messages(tasks.synthetic_conversations(spark, 8)), 40)
    run = training.Run(c, T.init_params(c), 12)
    losses = training.train_sft(run, packed, 12)
    assert losses[-1] < losses[0]
    with pytest.raises(ValueError, match="no packed rows"):
        training.train_sft(run, packed.limit(0), 1)
    bank = [([{"role": "user", "content": "What is 1 + 1?"}], 2)]
    before = run.params["layer0.q"].copy()
    means = training.run_grpo(spark, run, coder, bank, steps=1, group_size=4, prompts_per_step=2, max_new=4)
    assert len(means) == 1 and before.shape == run.params["layer0.q"].shape


def test_report(spark, tmp_path):
    rows = [("sft", "perplexity", 12.345), ("base", "perplexity", 20.0), ("zeta", "arc_easy", 0.5), ("base", "humaneval", 0.125)]
    df = spark.createDataFrame(rows, "checkpoint string, metric string, value double")
    lines = scoring.report(df).splitlines()
    assert lines[0] == "| Checkpoint | Perplexity (lower is better) | ARC-Easy (chance 25%) | HumanEval (chance 0%) |"
    assert [x.split(" | ")[0] for x in lines[2:]] == ["| base", "| sft", "| zeta"]
    assert lines[2] == "| base | 20.00 | — | 12.5% |"
    assert sorted(map(tuple, scoring.read_results(scoring.results_json(df)).collect())) == sorted(rows)
    scoring.write_results(df, str(tmp_path / "r"))
    assert sorted(map(tuple, scoring.load_results(spark, str(tmp_path / "r")).collect())) == sorted(rows)
