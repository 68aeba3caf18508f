"""A decoder-only Transformer in NumPy: forward pass, loss and hand-derived gradients.

Parameters are a dictionary of arrays, float64 as ``init_params`` makes them; the passes run in their
precision. Weight matrices are (out, in). The forward pass keeps what the backward pass needs; both are exact up
to rounding, see the gradient test.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from lexispark.functions.schedule import ModelConfig

Params = dict[str, np.ndarray]
EPS = 1e-6
IGNORE_INDEX = -100
#: Queries of a block of attention at least, and logits that are made at a time.
QUERIES = 32
LOGITS = 1 << 16
#: exp is taken without subtracting the maximum where no exponent can be larger, by bytes of a number.
SAFE_EXPONENT = {8: 300.0, 4: 30.0}


def init_params(c: ModelConfig, seed: int | None = None) -> Params:
    """Normal(0, 0.02) matrices, residual outputs scaled by (2 layers)^-1/2, unit gains."""
    rng = np.random.default_rng(c.seed if seed is None else seed)
    normal = lambda *shape: rng.normal(0.0, 0.02, shape)
    p: Params = {"embed": normal(c.vocab_size, c.d_model)}
    residual = (2 * c.n_layers) ** -0.5
    for i in range(c.n_layers):
        n = f"layer{i}."
        p |= {
            n + "attn_norm": np.ones(c.d_model), n + "q": normal(c.q_dim, c.d_model), n + "k": normal(c.kv_dim, c.d_model), n + "v": normal(c.kv_dim, c.d_model),
            n + "o": normal(c.d_model, c.q_dim) * residual, n + "mlp_norm": np.ones(c.d_model), n + "gate": normal(c.mlp_hidden, c.d_model),
            n + "up": normal(c.mlp_hidden, c.d_model), n + "down": normal(c.d_model, c.mlp_hidden) * residual,
        }
        if c.qk_norm:
            p |= {n + "q_norm": np.ones(c.head_dim), n + "k_norm": np.ones(c.head_dim)}
    p["final_norm"] = np.ones(c.d_model)
    return p


def num_parameters(p: Params) -> int:
    return sum(x.size for x in p.values())


def norm(x, w):
    r = 1.0 / np.sqrt((x * x).mean(-1, keepdims=True) + EPS)
    return x * r * w, r


def norm_back(dy, x, r, w):
    g = dy * w
    dx = r * g - x * r**3 * (g * x).mean(-1, keepdims=True)
    return dx, (dy * x * r).reshape(-1, x.shape[-1]).sum(0)


def rope_angles(length: int, head_dim: int, base: float, first: int = 0):
    angle = np.outer(np.arange(first, first + length), base ** (-2.0 * np.arange(head_dim // 2) / head_dim))
    angle = np.concatenate([angle, angle], axis=1)
    return np.cos(angle), np.sin(angle)


def rotate(x, cos, sin):
    half = x.shape[-1] // 2
    return x * cos + np.concatenate([-x[..., half:], x[..., :half]], -1) * sin


def query_blocks(length: int, window: int | None) -> list[tuple[int, int, int]]:
    """(first key, first query, end): blocks of queries, each with the only keys that it can see."""
    size = max(QUERIES, -(-length // 8))
    return [(0 if window is None else max(0, a - window + 1), a, min(length, a + size)) for a in range(0, length, size)]


@lru_cache(maxsize=256)
def causal(low: int, first: int, end: int, window: int | None, dtype: str = "float64") -> np.ndarray:
    """[1, 1, keys, 1, queries]: 1 where a query sees a key, not later and within the window, else 0."""
    i, j = np.arange(first, end)[None, :], np.arange(low, end)[:, None]
    return ((j <= i) & ((i - j < window) if window is not None else True)).astype(dtype)[None, None, :, None]


def visible(low: int, first: int, end: int, window: int | None, segments: np.ndarray | None, dtype: str = "float64") -> np.ndarray:
    """``causal``, and in one segment: [1 or B, 1, keys, 1, queries]."""
    allowed = causal(low, first, end, window, dtype)
    if segments is not None:
        allowed = allowed * (segments[:, low:end, None] == segments[:, None, first:end])[:, None, :, None]
    return allowed


def hidden_states(p: Params, c: ModelConfig, ids: np.ndarray, segments: np.ndarray | None = None) -> np.ndarray:
    """What the output head sees, [B, T, D]; logits are its products with the embeddings."""
    return (_layers(p, c, ids, segments)["xn"].T * p["final_norm"]).reshape(*ids.shape, -1)


def forward(p: Params, c: ModelConfig, ids: np.ndarray, segments: np.ndarray | None = None):
    """Logits [B, T, V] and the tape for ``backward``."""
    tape = _layers(p, c, ids, segments)
    return (tape["xn"].T @ (p["embed"] * p["final_norm"]).T).reshape(*ids.shape, -1), tape


# In the layers activations are [features, B * T], so that sums over features and rotations go along whole
# rows. A norm's gain is multiplied into the matrix behind it, and a query's scale into its gain.


def _normed(x):
    r = 1.0 / np.sqrt((x * x).sum(-2, keepdims=True) / x.shape[-2] + EPS)
    return x * r, r


def _normed_back(d, xn, r):
    """Gradient of what was normed; overwrites ``d``."""
    part = d * xn
    np.multiply(xn, part.sum(-2, keepdims=True) / xn.shape[-2], out=part)
    d -= part
    d *= r
    return d


def _gained_back(dz, xn, w, gain):
    """Gradients of w and gain where z = (w * gain) @ xn."""
    g = dz @ xn.T
    return g * gain, (w * g).sum(0)


def _turned(x, cos, sin):
    """``rotate`` for [heads, features, N]."""
    half = x.shape[1] // 2
    a, b = x[:, :half], x[:, half:]
    out, part = np.empty_like(x), np.empty_like(a)
    np.multiply(a, cos, out=out[:, :half])
    out[:, :half] -= np.multiply(b, sin, out=part)
    np.multiply(b, cos, out=out[:, half:])
    out[:, half:] += np.multiply(a, sin, out=part)
    return out


def _add_rows(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add column i of ``values`` [D, N] to row at[i] of ``total`` [V, D]."""
    # a small total is added to whole, of a large one only the rows that occur
    rows, place = (slice(None), at) if len(total) <= len(at) else np.unique(at, return_inverse=True)
    d, n = len(values), len(total) if len(total) <= len(at) else len(rows)
    place = place.reshape(1, -1) * d + np.arange(d)[:, None]
    total[rows] += np.bincount(place.ravel(), values.ravel(), n * d).reshape(-1, d)


def _exponents(s: np.ndarray, allowed: np.ndarray, bound: float) -> np.ndarray:
    """exp(s) where allowed, else 0, of scores [B, heads, keys, copies * queries] in place. Up to a factor for each
    query, which its sum takes out again: below the bound no maximum has to be subtracted."""
    each = s.reshape(*s.shape[:3], -1, allowed.shape[-1])
    if bound > SAFE_EXPONENT[s.itemsize]:
        np.copyto(each, -np.inf, where=allowed == 0)
        s -= s.max(-2, keepdims=True)
    np.exp(s, out=s)
    each *= allowed
    return s


def _matrices(c: ModelConfig, p: Params, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, keys and values as one matrix, gate and up as one, and the gains of the heads [heads, features, 1]."""
    n = f"layer{i}."
    gain = np.ones((c.n_q_heads + c.n_kv_heads, c.head_dim), p[n + "q"].dtype)
    if c.qk_norm:
        gain[: c.n_q_heads], gain[c.n_q_heads :] = p[n + "q_norm"], p[n + "k_norm"]
    gain[: c.n_q_heads] /= np.sqrt(c.head_dim)
    return np.concatenate([p[n + "q"], p[n + "k"], p[n + "v"]]), np.concatenate([p[n + "gate"], p[n + "up"]]), gain[..., None]


def _layers(p: Params, c: ModelConfig, ids: np.ndarray, segments: np.ndarray | None) -> dict:
    b, t = ids.shape
    kv, d, rep, heads = c.n_kv_heads, c.head_dim, c.n_q_heads // c.n_kv_heads, c.n_q_heads + c.n_kv_heads
    dtype = p["embed"].dtype
    cos, sin = (np.tile(x[:, : d // 2].T.astype(dtype), b) for x in rope_angles(t, d, c.rope_base))
    x = np.ascontiguousarray(p["embed"][ids.ravel()].T)
    tape: dict = {"ids": ids, "layers": [], "cos": cos, "sin": sin}
    for i in range(c.n_layers):
        n, s = f"layer{i}.", {}
        s["matrices"] = qkv, gate_up, gain = _matrices(c, p, i)
        s["x1"], s["r1"] = _normed(x)
        z = ((qkv * p[n + "attn_norm"]) @ s["x1"]).reshape(-1, d, b * t)
        qk = z[:heads]
        if c.qk_norm:
            qk, s["rqk"] = _normed(qk)
        s["qk"] = qk
        qk = _turned(qk * gain, cos, sin)
        size = (qk * qk).sum(1)
        bound = float(np.sqrt(size[: c.n_q_heads].max() * size[c.n_q_heads :].max()))
        q = qk[: c.n_q_heads].reshape(kv, rep, d, b, t).transpose(3, 0, 2, 1, 4)
        k = qk[c.n_q_heads :].reshape(kv, d, b, t).transpose(2, 0, 1, 3)
        v = np.ones((b, kv, d + 1, t), dtype)  # the row of ones gives the sums of the weights
        v[:, :, :d] = z[heads:].reshape(kv, d, b, t).transpose(2, 0, 1, 3)
        o, total = np.empty((kv, rep, d, b, t), dtype), np.empty((b, kv, rep, t), dtype)
        window = None if c.full_attention(i) else c.window
        s["blocks"] = []
        for low, first, end in query_blocks(t, window):
            own = q[..., first:end].reshape(b, kv, d, -1)
            e = _exponents(k[..., low:end].swapaxes(-1, -2) @ own, visible(low, first, end, window, segments, dtype.name), bound)
            w = (v[..., low:end] @ e).reshape(b, kv, d + 1, rep, -1)
            total[..., first:end] = w[:, :, d]
            o[..., first:end] = (w[:, :, :d] / w[:, :, d:]).transpose(1, 3, 2, 0, 4)
            s["blocks"].append((low, first, end, own, e))
        s |= {"k": k, "v": v, "o": o.reshape(c.q_dim, b * t), "total": total}
        x = x + p[n + "o"] @ s["o"]
        s["x2"], s["r2"] = _normed(x)
        gu = (gate_up * p[n + "mlp_norm"]) @ s["x2"]
        g, s["u"] = gu[: c.mlp_hidden], gu[c.mlp_hidden :]
        sig = np.exp(-g)
        sig += 1.0
        np.reciprocal(sig, out=sig)
        s |= {"sig": sig, "gs": g * sig}
        s["m"] = s["gs"] * s["u"]
        x = x + p[n + "down"] @ s["m"]
        tape["layers"].append(s)
    tape["xn"], tape["rf"] = _normed(x)
    return tape


class Cache:
    """Keys and values of the tokens that a model has seen, for ``rows`` sequences of up to ``size``
    tokens; ``work`` counts the positions that went through the layers."""

    def __init__(self, c: ModelConfig, rows: int, size: int):
        shape = (c.n_layers, rows, c.n_kv_heads, size, c.head_dim)
        self.keys, self.values = np.empty(shape), np.empty(shape)
        self.length = self.work = 0


def extend(p: Params, c: ModelConfig, cache: Cache, ids: np.ndarray) -> np.ndarray:
    """Hidden states [B, T, D] of further tokens, which see those in the cache and join them."""
    b, t = ids.shape
    past, rep = cache.length, c.n_q_heads // c.n_kv_heads
    cos, sin = rope_angles(t, c.head_dim, c.rope_base, past)
    split = lambda y, heads: y.reshape(b, t, heads, c.head_dim).transpose(0, 2, 1, 3)
    x = p["embed"][ids]
    for i in range(c.n_layers):
        n = f"layer{i}."
        h = norm(x, p[n + "attn_norm"])[0]
        q, k = split(h @ p[n + "q"].T, c.n_q_heads), split(h @ p[n + "k"].T, c.n_kv_heads)
        if c.qk_norm:
            q, k = norm(q, p[n + "q_norm"])[0], norm(k, p[n + "k_norm"])[0]
        cache.keys[i, :, :, past : past + t] = rotate(k, cos, sin)
        cache.values[i, :, :, past : past + t] = split(h @ p[n + "v"].T, c.n_kv_heads)
        window = None if c.full_attention(i) else c.window
        low = 0 if window is None else max(0, past - window + 1)
        keys, values = cache.keys[i, :, :, None, low : past + t], cache.values[i, :, :, None, low : past + t]
        own, seen = np.arange(past, past + t)[:, None], np.arange(low, past + t)[None, :]
        allowed = (seen <= own) & ((own - seen < window) if window is not None else True)
        q = rotate(q, cos, sin).reshape(b, c.n_kv_heads, rep, t, c.head_dim)
        a = np.where(allowed, q @ keys.swapaxes(-1, -2) / np.sqrt(c.head_dim), -np.inf)
        a = np.exp(a - a.max(-1, keepdims=True))
        a /= a.sum(-1, keepdims=True)
        x = x + (a @ values).reshape(b, c.n_q_heads, t, c.head_dim).transpose(0, 2, 1, 3).reshape(b, t, c.q_dim) @ p[n + "o"].T
        h = norm(x, p[n + "mlp_norm"])[0]
        g = h @ p[n + "gate"].T
        x = x + (g / (1.0 + np.exp(-g)) * (h @ p[n + "up"].T)) @ p[n + "down"].T
    cache.length, cache.work = past + t, cache.work + t
    return norm(x, p["final_norm"])[0]


def log_softmax(logits: np.ndarray) -> np.ndarray:
    z = logits - logits.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def backward(p: Params, c: ModelConfig, tape: dict, dlogits: np.ndarray) -> Params:
    """Gradients of all parameters for a gradient of the logits."""
    d = dlogits.reshape(-1, dlogits.shape[-1]).T
    embed, gain = _gained_back(d, tape["xn"], p["embed"], p["final_norm"])
    return _layers_back(p, c, tape, (p["embed"] * p["final_norm"]).T @ d, {"embed": embed, "final_norm": gain})


def _layers_back(p: Params, c: ModelConfig, tape: dict, dxn: np.ndarray, grads: Params) -> Params:
    """``grads``, which has those of the head, with all others, for a gradient of the last normed states (overwritten)."""
    ids, cos, sin = tape["ids"], tape["cos"], tape["sin"]
    b, t = ids.shape
    kv, d, rep, heads = c.n_kv_heads, c.head_dim, c.n_q_heads // c.n_kv_heads, c.n_q_heads + c.n_kv_heads
    dx = _normed_back(dxn, tape["xn"], tape["rf"])
    for i in reversed(range(c.n_layers)):
        n, s = f"layer{i}.", tape["layers"][i]
        qkv, gate_up, gain = s["matrices"]
        grads[n + "down"] = dx @ s["m"].T
        dm = p[n + "down"].T @ dx
        dgu = np.empty((2 * c.mlp_hidden, b * t), dx.dtype)
        np.multiply(dm, s["gs"], out=dgu[c.mlp_hidden :])
        dm *= s["u"]
        slope = s["gs"] * s["sig"]
        np.subtract(s["gs"], slope, out=slope)
        slope += s["sig"]
        np.multiply(dm, slope, out=dgu[: c.mlp_hidden])
        g, grads[n + "mlp_norm"] = _gained_back(dgu, s["x2"], gate_up, p[n + "mlp_norm"])
        grads[n + "gate"], grads[n + "up"] = g[: c.mlp_hidden], g[c.mlp_hidden :]
        dx = dx + _normed_back((gate_up * p[n + "mlp_norm"]).T @ dgu, s["x2"], s["r2"])
        grads[n + "o"] = dx @ s["o"].T
        do = p[n + "o"].T @ dx
        own = (do * s["o"]).reshape(kv, rep, d, b, t).sum(2)
        part = np.empty((b, kv, d + 1, rep, t), dx.dtype)  # of the weighted values, and below of the sums
        np.divide(do.reshape(kv, rep, d, b, t).transpose(3, 0, 2, 1, 4), s["total"][:, :, None], out=part[:, :, :d])
        np.divide(own.transpose(2, 0, 1, 3), -s["total"], out=part[:, :, d])
        dz = np.empty((heads + kv, d, b * t), dx.dtype)
        dq = dz[: c.n_q_heads].reshape(kv, rep, d, b, t)
        dk, dv = np.zeros((b, kv, t, d), dx.dtype), np.zeros((b, kv, t, d), dx.dtype)
        for low, first, end, q, e in s["blocks"]:
            w = part[..., first:end].reshape(b, kv, d + 1, -1)
            dv[..., low:end, :] += e @ w[:, :, :d].swapaxes(-1, -2)
            ds = s["v"][..., low:end].swapaxes(-1, -2) @ w
            ds *= e
            dq[..., first:end] = (s["k"][..., low:end] @ ds).reshape(b, kv, d, rep, -1).transpose(1, 3, 2, 0, 4)
            dk[..., low:end, :] += ds @ q.swapaxes(-1, -2)
        dz[c.n_q_heads : heads].reshape(kv, d, b, t)[:] = dk.transpose(1, 3, 0, 2)
        dz[heads:].reshape(kv, d, b, t)[:] = dv.transpose(1, 3, 0, 2)
        dqk = _turned(dz[:heads], cos, -sin)
        if c.qk_norm:
            g = np.einsum("hdn,hdn->hd", dqk, s["qk"])
            grads[n + "q_norm"], grads[n + "k_norm"] = g[: c.n_q_heads].sum(0) / d**0.5, g[c.n_q_heads :].sum(0)
        dqk *= gain
        dz[:heads] = _normed_back(dqk, s["qk"], s["rqk"]) if c.qk_norm else dqk
        dz = dz.reshape(-1, b * t)
        g, grads[n + "attn_norm"] = _gained_back(dz, s["x1"], qkv, p[n + "attn_norm"])
        grads[n + "q"], grads[n + "k"], grads[n + "v"] = np.split(g, [c.q_dim, c.q_dim + c.kv_dim])
        dx = dx + _normed_back((qkv * p[n + "attn_norm"]).T @ dz, s["x1"], s["r1"])
    _add_rows(grads["embed"], ids.ravel(), dx)
    return grads


def supervised(targets: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    return targets if mask is None else np.where(mask == 0, IGNORE_INDEX, targets)


def loss_sums(p: Params, c: ModelConfig, ids, targets, mask=None, segments=None, *, weights=None, grad: bool = True):
    """(sum of cross-entropy, supervised targets, gradients of the sum); each row's share in the
    sum can be weighted. Logits are made for supervised targets only, some of them at a time."""
    tape = _layers(p, c, ids, segments)
    tgt = supervised(targets, mask).ravel()
    rows = np.flatnonzero(tgt != IGNORE_INDEX)
    dtype = p["embed"].dtype
    share = np.ones(len(rows), dtype) if weights is None else np.repeat(np.asarray(weights, dtype), ids.shape[1])[rows]
    xn, tgt, total = np.take(tape["xn"], rows, axis=1), tgt[rows], 0.0
    head = p["embed"] * p["final_norm"]
    bound = float(np.sqrt((head * head).sum(1).max() * (xn * xn).sum(0).max(initial=0.0)))
    d, g = np.empty_like(xn), np.zeros_like(head)
    step = max(64, LOGITS // len(head))
    for a in range(0, len(rows), step):
        x, y, w = xn[:, a : a + step], tgt[a : a + step], share[a : a + step]
        z, each = head @ x, np.arange(len(y))
        if bound > SAFE_EXPONENT[z.itemsize]:
            z -= z.max(0)
        hit = z[y, each]
        np.exp(z, out=z)
        sums = z.sum(0, dtype=float)
        total += float(((np.log(sums) - hit) * w).sum())
        if grad:
            w = (w / sums).astype(dtype)
            z[y, each] -= sums.astype(dtype)
            g += z @ (x * w).T
            np.multiply(head.T @ z, w, out=d[:, a : a + step])
    if not grad:
        return total, len(rows), None
    dxn = np.zeros_like(tape["xn"])
    dxn[:, rows] = d
    return total, len(rows), _layers_back(p, c, tape, dxn, {"embed": g * p["final_norm"], "final_norm": (p["embed"] * g).sum(0)})


def loss_and_grads(p: Params, c: ModelConfig, ids, targets, mask=None, segments=None):
    """Mean loss over supervised targets (0 where there is none) and its gradients."""
    total, n, grads = loss_sums(p, c, ids, targets, mask, segments)
    n = max(1, n)
    return total / n, {k: g / n for k, g in grads.items()}


def chunked_cross_entropy(hidden: np.ndarray, weight: np.ndarray, targets: np.ndarray, chunk: int, ignore: int = IGNORE_INDEX):
    """(loss, d hidden, d weight) of hidden @ weight.T in tiles of the vocabulary.

    Only one tile of logits exists at a time; the backward pass makes it again from the kept
    log-sum-exp.
    """
    valid = targets != ignore
    n = max(1, int(valid.sum()))
    peak, total, hit = np.full(len(hidden), -np.inf), np.zeros(len(hidden)), np.zeros(len(hidden))
    tiles = [(a, min(a + chunk, len(weight))) for a in range(0, len(weight), chunk)]

    def own(a, b):
        rows = np.flatnonzero(valid & (targets >= a) & (targets < b))
        return rows, targets[rows] - a

    for a, b in tiles:
        z = hidden @ weight[a:b].T
        top = np.maximum(peak, z.max(1))
        total = total * np.exp(peak - top) + np.exp(z - top[:, None]).sum(1)
        peak = top
        rows, cols = own(a, b)
        hit[rows] = z[rows, cols]
    lse = peak + np.log(total)
    dh, dw = np.zeros_like(hidden), np.zeros_like(weight)
    for a, b in tiles:
        d = np.exp(hidden @ weight[a:b].T - lse[:, None])
        rows, cols = own(a, b)
        d[rows, cols] -= 1.0
        d *= valid[:, None] / n
        dh += d @ weight[a:b]
        dw[a:b] = d.T @ hidden
    return float(((lse - hit) * valid).sum() / n), dh, dw
