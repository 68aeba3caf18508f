"""The model's passes against plain ones: one query, one key, one logit at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lexispark.functions import schedule
from lexispark.model import gradients
from lexispark.model import transformer as T

C = schedule.get_config("nano", vocab_size=384, d_model=16, n_layers=2, n_q_heads=4, n_kv_heads=2, head_dim=4, mlp_hidden=24, context=80, window=5, micro_batch=2, grad_accum=1)


def plain_loss(p, c, ids, targets, mask, segments, weights):
    """The weighted sum of cross-entropy, without matrices of queries and keys."""
    total = 0.0
    for row in range(len(ids)):
        x = p["embed"][ids[row]]
        cos, sin = T.rope_angles(len(x), c.head_dim, c.rope_base)
        for i in range(c.n_layers):
            n = f"layer{i}."
            h = T.norm(x, p[n + "attn_norm"])[0]
            q, k, v = ((h @ p[n + m].T).reshape(len(x), -1, c.head_dim) for m in "qkv")
            if c.qk_norm:
                q, k = T.norm(q, p[n + "q_norm"])[0], T.norm(k, p[n + "k_norm"])[0]
            q, k = (T.rotate(y, cos[:, None], sin[:, None]) for y in (q, k))
            out = np.zeros_like(q)
            for a in range(len(x)):
                seen = [b for b in range(a + 1) if segments[row, a] == segments[row, b] and (c.full_attention(i) or a - b < c.window)]
                for head in range(c.n_q_heads):
                    own = head * c.n_kv_heads // c.n_q_heads
                    s = np.array([q[a, head] @ k[b, own] for b in seen]) / np.sqrt(c.head_dim)
                    s = np.exp(s - s.max())
                    out[a, head] = (s / s.sum()) @ v[seen, own]
            x = x + out.reshape(len(x), -1) @ p[n + "o"].T
            h = T.norm(x, p[n + "mlp_norm"])[0]
            g = h @ p[n + "gate"].T
            x = x + (g / (1 + np.exp(-g)) * (h @ p[n + "up"].T)) @ p[n + "down"].T
        logp = T.log_softmax(T.norm(x, p["final_norm"])[0] @ p["embed"].T)
        total -= weights[row] * sum(logp[a, targets[row, a]] for a in np.flatnonzero(mask[row]))
    return total


def inputs(length, rows=3, seed=0):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 384, (rows, length + 1))
    return ids[:, :-1], ids[:, 1:], rng.integers(0, 2, (rows, length)), np.sort(rng.integers(0, 3, (rows, length)), axis=1), rng.random(rows)


@pytest.mark.parametrize("length", [1, 31, 32, 33, 80])
@pytest.mark.parametrize("qk_norm", [True, False])
@pytest.mark.parametrize("factor", [1.0, 8.0, 400.0])
def test_loss_equals_a_plain_one(length, qk_norm, factor):
    """Factors from where no exponent needs its maximum to where exp would overflow."""
    c = schedule.replace(C, qk_norm=qk_norm)
    rng = np.random.default_rng(1)
    p = {k: v * (1 + 0.1 * rng.normal(size=v.shape)) * (factor if k.endswith(("embed", "_norm")) else 1.0) for k, v in T.init_params(c).items()}
    x, y, mask, seg, weights = inputs(length)
    want = plain_loss(p, c, x, y, mask, seg, weights)
    got, n, grads = T.loss_sums(p, c, x, y, mask, seg, weights=weights)
    assert got == pytest.approx(want, rel=1e-9) and n == mask.sum() and np.isfinite(got)
    assert T.loss_sums(p, c, x, y, mask, seg, weights=weights, grad=False) == (got, n, None)
    assert grads.keys() == p.keys() and all(g.shape == p[k].shape and np.isfinite(g).all() for k, g in grads.items())


@pytest.mark.parametrize("qk_norm", [True, False])
def test_gradients_over_several_blocks(qk_norm):
    c = schedule.replace(C, qk_norm=qk_norm)
    rng = np.random.default_rng(2)
    p = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in T.init_params(c).items()}
    x, y, mask, seg, weights = inputs(70)
    grads = T.loss_sums(p, c, x, y, mask, seg, weights=weights)[2]
    for name, v in p.items():
        way = rng.normal(size=v.shape)
        sides = [T.loss_sums({**p, name: v + step * way}, c, x, y, mask, seg, weights=weights, grad=False)[0] for step in (1e-5, -1e-5)]
        assert (grads[name] * way).sum() == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-5, abs=1e-6), name


def test_backward_of_given_logits():
    rng = np.random.default_rng(3)
    p = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in T.init_params(C).items()}
    x, y, mask, seg, _ = inputs(40)
    z, tape = T.forward(p, C, x, seg)
    d = np.exp(T.log_softmax(z))
    np.put_along_axis(d, y[..., None], np.take_along_axis(d, y[..., None], -1) - 1.0, -1)
    got, want = T.backward(p, C, tape, d * mask[..., None]), T.loss_sums(p, C, x, y, mask, seg)[2]
    assert all(np.allclose(got[k], want[k]) for k in p)
    assert np.allclose(T.hidden_states(p, C, x, seg) @ p["embed"].T, z)


def test_nothing_is_made_for_pairs_and_logits_that_do_not_count():
    """Of 8 windows of 512 positions with 1 target of 16, all logits would be 12 MB, the pairs of a windowed layer 64 MB."""
    c = schedule.replace(C, context=512, window=16, n_layers=1)
    x, y, mask, _, _ = inputs(512, rows=8)
    mask = mask * (np.arange(512) % 16 == 0)
    p = T.init_params(c)
    tracemalloc.start()
    T.loss_sums(p, c, x, y, mask)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_matrix():
    rows = pa.array([[1, 2], [3, 4], [5, 6]], pa.list_(pa.int32()))
    assert gradients.matrix(rows.slice(1, 2)).tolist() == [[3, 4], [5, 6]]
    assert gradients.matrix(pa.array([0.5, 1.0])).tolist() == [0.5, 1.0]
    with pytest.raises(ValueError, match="different lengths"):
        gradients.matrix(pa.array([[1, 2, 3], [4]]))
