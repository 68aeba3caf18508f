"""Logits providers: functions from ids [B, T] to logits [B, T, V].

Scoring needs no logits, only the log-probability of each target. A provider may therefore have
``target_logprobs(ids, targets)``, which returns these [B, T] without ever holding a row of V logits;
``target_logprobs`` below uses it, and for any other provider takes the logits a few positions at a time.
``rows_at_a_time`` says how many sequences a provider likes to see at once.

Generation needs the last position's logits only. A provider with ``start(rows, size)``, which makes a state
for sequences of up to ``size`` tokens, and ``extend(state, ids)``, which shows it further tokens and
returns the last one's logits [B, V], is not shown a token twice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.schedule import ModelConfig
from lexispark.model.transformer import Cache, Params, extend, forward, hidden_states

Provider = Callable[[np.ndarray], np.ndarray]

#: Values of a tile of logits.
TILE = 1 << 20
#: Sequences whose pairs are counted at a time.
SEQUENCES = 256


def log_sum_exp(hidden: np.ndarray, weight: np.ndarray, tile: int = TILE) -> np.ndarray:
    """Of hidden [N, D] @ weight.T [D, V] along V, with at most ``tile`` logits at a time."""
    columns = max(1, tile // max(1, len(hidden)))
    peak, total = np.full(len(hidden), -np.inf), np.zeros(len(hidden))
    for a in range(0, len(weight), columns):
        z = hidden @ weight[a : a + columns].T
        top = np.maximum(peak, z.max(1))
        total = total * np.exp(peak - top) + np.exp(z - top[:, None]).sum(1)
        peak = top
    return peak + np.log(total)


def target_logprobs(provider: Provider, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """log p of the targets [B, T] behind each prefix of ids [B, T]."""
    own = getattr(provider, "target_logprobs", None)
    if own is not None:
        return own(ids, targets)
    logits = np.asarray(provider(ids))
    flat, at = logits.reshape(-1, logits.shape[-1]), targets.ravel()
    out = np.empty(len(at))
    rows = max(1, TILE // max(1, flat.shape[1]))
    for a in range(0, len(at), rows):
        z = flat[a : a + rows].astype(np.float64)
        peak = z.max(1)
        out[a : a + rows] = z[np.arange(len(z)), at[a : a + rows]] - peak - np.log(np.exp(z - peak[:, None]).sum(1))
    return out.reshape(targets.shape)


def adjacent(column: pa.Array, vocab_size: int) -> np.ndarray:
    """a * vocab_size + b for each two adjacent ids (a, b) of the sequences of a list column."""
    column = column.drop_null()
    values, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy()
    inside = np.ones(max(0, len(values) - 1), bool)
    ends = np.cumsum(lengths)
    ends = ends[(ends > 0) & (ends < len(values))]
    inside[ends - 1] = False
    return (values[:-1] * vocab_size + values[1:])[inside]


class Uniform:
    rows_at_a_time = 1 << 14

    def __init__(self, vocab_size: int):
        self.vocab_size = vocab_size

    def target_logprobs(self, ids, targets):
        return np.full(np.shape(targets), -np.log(self.vocab_size))

    def __call__(self, ids):
        return np.zeros((*ids.shape, self.vocab_size))

    def start(self, rows, size):
        return None

    def extend(self, state, ids):
        return np.zeros((len(ids), self.vocab_size))


class Preferred:
    """Always the given tokens, the first most; others are far behind."""

    rows_at_a_time = 1 << 14

    def __init__(self, vocab_size: int, tokens: list[int], strength: float = 5.0):
        self.row = np.full(vocab_size, -strength)
        self.row[tokens] = strength - np.arange(len(tokens))

    def target_logprobs(self, ids, targets):
        return self.row[targets] - np.log(np.exp(self.row).sum())

    def __call__(self, ids):
        return np.broadcast_to(self.row, (*ids.shape, len(self.row)))

    def start(self, rows, size):
        return None

    def extend(self, state, ids):
        return np.broadcast_to(self.row, (len(ids), len(self.row)))


class Bigram:
    """Add-one bigram counts of token sequences; pickles as one matrix, for small vocabularies."""

    rows_at_a_time = 1 << 14

    def __init__(self, counts: np.ndarray):
        self.log_p = np.log((counts + 1.0) / (counts.sum(1, keepdims=True) + counts.shape[1]))

    @classmethod
    def fit(cls, sequences, vocab_size: int) -> Bigram:
        counts = np.zeros((vocab_size, vocab_size))
        for s in sequences:
            np.add.at(counts, (np.asarray(s[:-1], int), np.asarray(s[1:], int)), 1.0)
        return cls(counts)

    @classmethod
    def fit_table(cls, sequences: DataFrame, vocab_size: int) -> Bigram:
        """The same over a column of sequences: what comes to the driver is one matrix."""

        cells = vocab_size * vocab_size

        def run(batches):
            # a small matrix is kept for the task, of a large one each slice sends on what it saw
            total = np.zeros(cells, np.int64) if cells <= TILE else None
            for batch in batches:
                for at in range(0, batch.num_rows, SEQUENCES):
                    pair = adjacent(batch.column(0).slice(at, SEQUENCES), vocab_size)
                    if total is not None:
                        for a in range(0, len(pair), TILE):
                            total += np.bincount(pair[a : a + TILE], minlength=cells)
                    else:
                        pair, n = np.unique(pair, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])
            if total is not None:
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["pair", "n"])

        counts = np.zeros(vocab_size * vocab_size)
        for row in sequences.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            counts[row["pair"]] = row["n"]
        return cls(counts.reshape(vocab_size, vocab_size))

    def __call__(self, ids):
        return self.log_p[ids]

    def target_logprobs(self, ids, targets):
        return self.log_p[ids, targets]  # rows are normalised

    def start(self, rows, size):
        return None

    def extend(self, state, ids):
        return self.log_p[ids[:, -1]]


class Transformer:
    def __init__(self, params: Params, config: ModelConfig):
        self.params, self.config = params, config

    @property
    def context(self) -> int:
        return self.config.context

    def __call__(self, ids):
        return forward(self.params, self.config, np.asarray(ids))[0]

    def target_logprobs(self, ids, targets):
        ids, targets = np.asarray(ids), np.asarray(targets)
        hidden, head = hidden_states(self.params, self.config, ids), self.params["embed"]
        flat, at = hidden.reshape(-1, hidden.shape[-1]), targets.ravel()
        own = np.einsum("ij,ij->i", flat, head[at])
        return (own - log_sum_exp(flat, head)).reshape(targets.shape)

    def start(self, rows, size):
        return Cache(self.config, rows, size)

    def extend(self, state, ids):
        return extend(self.params, self.config, state, np.asarray(ids))[:, -1] @ self.params["embed"].T
