"""Optimisers with explicit state: Muon for hidden matrices, AdamW for the rest."""

from __future__ import annotations

import numpy as np

from lexispark.functions.schedule import ModelConfig, WarmupCosine
from lexispark.model.transformer import Params

# The coefficients of the quintic iteration.
QUINTIC = (3.4445, -4.7750, 2.0315)


def orthogonalized(g: np.ndarray, steps: int = 5, eps: float = 1e-7) -> np.ndarray:
    """Approximate polar factor of a matrix by Newton-Schulz steps on its smaller side."""
    a, b, c = QUINTIC
    x = g.T if g.shape[0] > g.shape[1] else g
    x = x / (np.linalg.norm(x) + eps)
    for _ in range(steps):
        s = x @ x.T
        x = a * x + (b * s + c * s @ s) @ x
    return x.T if g.shape[0] > g.shape[1] else x


def parameter_group(name: str, value: np.ndarray) -> str:
    return "hidden" if value.ndim >= 2 and "embed" not in name else "misc"


def clip(grads: Params, limit: float) -> tuple[Params, float]:
    """Gradients scaled to a global norm of at most ``limit`` (0: unlimited), and the norm."""
    size = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
    scale = min(1.0, limit / (size + 1e-6)) if limit else 1.0
    return {k: g * scale for k, g in grads.items()}, size


class Optimizer:
    """Both groups of one model; ``rates`` come from the schedule at every step."""

    def __init__(self, c: ModelConfig, params: Params, *, use_muon: bool | None = None):
        self.c, self.use_muon = c, c.use_muon if use_muon is None else use_muon
        self.group = {k: parameter_group(k, v) for k, v in params.items()}
        self.base_rates = {"hidden": c.lr_muon if self.use_muon else c.lr_adamw, "misc": c.lr_adamw}
        self.first = {k: np.zeros_like(v) for k, v in params.items()}  # momentum
        self.second = {k: np.zeros_like(v) for k, v in params.items() if not self._muon(k)}
        self.steps = 0

    def _muon(self, name: str) -> bool:
        return self.use_muon and self.group[name] == "hidden"

    def step(self, params: Params, grads: Params, rates: dict[str, float]) -> None:
        """Update ``params`` in place."""
        self.steps += 1
        for name, g in grads.items():
            p, rate = params[name], rates[self.group[name]]
            decay = self.c.weight_decay if self.group[name] == "hidden" else 0.0
            p *= 1.0 - rate * decay
            if self._muon(name):
                m = self.first[name]
                m *= 0.95
                m += g
                p -= rate * max(1.0, p.shape[0] / p.shape[1]) ** 0.5 * orthogonalized(g + 0.95 * m)
            else:
                b1, b2 = self.c.adam_beta1, self.c.adam_beta2
                m, v = self.first[name], self.second[name]
                m += (1 - b1) * (g - m)
                v += (1 - b2) * (g * g - v)
                p -= rate * (m / (1 - b1**self.steps)) / (np.sqrt(v / (1 - b2**self.steps)) + 1e-8)

    def state(self) -> dict:
        return {"steps": self.steps, "first": {k: v.copy() for k, v in self.first.items()}, "second": {k: v.copy() for k, v in self.second.items()}}

    def load_state(self, state: dict) -> None:
        if self.first.keys() != state["first"].keys() or self.second.keys() != state["second"].keys():
            raise ValueError("the state belongs to other parameters")
        self.steps = state["steps"]
        self.first = {k: v.copy() for k, v in state["first"].items()}
        self.second = {k: v.copy() for k, v in state["second"].items()}


def scheduler(c: ModelConfig, optimizer: Optimizer, steps: int | None = None) -> WarmupCosine:
    """The schedule of a run; shorter runs warm up for at most a tenth of their steps."""
    total = c.max_steps if steps is None else steps
    warmup = c.warmup_steps if steps is None else min(c.warmup_steps, max(1, steps // 10))
    return WarmupCosine(optimizer.base_rates, warmup, total, c.lr_floor_frac)
