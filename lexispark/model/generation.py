"""Autoregressive generation, replies and sampled groups, on the driver or in Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexispark.functions.bpe import BpeTokenizer
from lexispark.functions.vocab import ROLE_IDS
from lexispark.model.providers import Provider, target_logprobs


def next_tokens(logits: np.ndarray, temperature: float, top_k: int | None, rng: np.random.Generator | None) -> np.ndarray:
    """Greedy (first of equal ones) at temperature 0 or below, else a sample of the softmax over
    the top-k logits, ties at the threshold included."""
    if temperature <= 0:
        return logits.argmax(-1)
    z = logits / temperature
    if top_k is not None:
        kth = -np.sort(-z, axis=-1)[:, min(top_k, z.shape[-1]) - 1]
        z = np.where(z < kth[:, None], -np.inf, z)
    p = np.exp(z - z.max(-1, keepdims=True))
    cumulative = np.cumsum(p, axis=-1)
    u = rng.random(len(z)) * cumulative[:, -1]
    return np.minimum((cumulative <= u[:, None]).sum(-1), z.shape[-1] - 1)


class Draws:
    """Uniform numbers for rows in groups of one size; each group has a generator of its own, so its
    draws do not depend on what it is batched with."""

    def __init__(self, seeds: list[int | None], size: int):
        self.generators, self.size = [np.random.default_rng(s) for s in seeds], size

    def random(self, n: int) -> np.ndarray:
        return np.concatenate([g.random(self.size) for g in self.generators])


def generate(provider: Provider, ids: np.ndarray, *, max_new: int, temperature: float = 0.0, top_k: int | None = None, eos: int | None = None, seed: int | None = None, context: int | None = None, draws=None) -> np.ndarray:
    """Extend ids [B, T] by up to ``max_new`` tokens.

    A row that has ended keeps emitting eos; when all have, it stops. At most the last
    ``context`` tokens are shown to the provider.

    A provider with ``start`` and ``extend`` keeps what it has computed for the tokens it has seen, and is
    shown each token once. When the text outgrows the context its first tokens drop out, which changes
    all states behind them, so from there on the provider sees the whole context again for each token.
    """
    context = context if context is not None else getattr(provider, "context", None)
    rng = draws or (np.random.default_rng(seed) if temperature > 0 else None)
    done = np.zeros(len(ids), dtype=bool)
    state, seen = None, 0
    for step in range(max_new):
        if hasattr(provider, "extend") and (context is None or ids.shape[1] <= context):
            if state is None:
                full = ids.shape[1] + max_new - step
                state = provider.start(len(ids), full if context is None else min(full, context))
            logits, seen = provider.extend(state, ids[:, seen:]), ids.shape[1]
        else:
            logits = provider(ids if context is None else ids[:, -context:])[:, -1, :]
        token = next_tokens(logits, temperature, top_k, rng)
        if eos is not None:
            token = np.where(done, eos, token)
            done |= token == eos
        ids = np.concatenate([ids, token[:, None]], axis=1)
        if eos is not None and done.all():
            break
    return ids


#: Rows that are extended together.
ROWS_AT_A_TIME = 64


def generate_all(provider: Provider, prompts: list[list[int]], *, max_new: int, eos: int, copies: int = 1, seeds: list[int] | None = None, temperature: float = 0.0, **options) -> list:
    """The new tokens of each prompt, up to and with its first eos; ``copies`` lists of them for each where
    there are several. Prompts of one length are extended together."""
    out: list = [None] * len(prompts)
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(prompts):
        by_length.setdefault(len(p), []).append(i)
    many = max(1, ROWS_AT_A_TIME // copies)
    for length, members in by_length.items():
        for a in range(0, len(members), many):
            own = members[a : a + many]
            ids = np.repeat(np.array([prompts[i] for i in own], dtype=np.int64).reshape(len(own), length), copies, axis=0)
            draws = Draws([seeds[i] if seeds else None for i in own], copies) if temperature > 0 else None
            rows = generate(provider, ids, max_new=max_new, eos=eos, temperature=temperature, draws=draws, **options)[:, length:].tolist()
            cut = [new[: new.index(eos) + 1] if eos in new else new for new in rows]
            for k, i in enumerate(own):
                out[i] = cut[k] if copies == 1 else cut[k * copies : (k + 1) * copies]
    return out


def rendered(messages: list[dict], tokenizer: BpeTokenizer, *, prompt: bool = False) -> tuple[list[int], list[int]]:
    """Ids and loss mask of one conversation, as ``operators.chat.render`` makes for tables."""
    ids, mask = [tokenizer.bos_id], [0]
    for m in messages:
        if m["role"] not in ROLE_IDS:
            raise ValueError(f"unknown role {m['role']!r}")
        own = [*tokenizer.encode(m["content"]), tokenizer.eos_id]
        ids += [ROLE_IDS[m["role"]], *own]
        mask += [0] + [int(m["role"] == "assistant")] * len(own)
    if prompt:
        ids.append(ROLE_IDS["assistant"])
        mask.append(0)
    return ids, mask


def reply(provider: Provider, tokenizer: BpeTokenizer, messages: list[dict], *, max_new: int = 128, **options) -> str:
    """The assistant's next turn, up to its eos."""
    prompt, _ = rendered(messages, tokenizer, prompt=True)
    out = generate(provider, np.array([prompt]), max_new=max_new, eos=tokenizer.eos_id, **options)[0, len(prompt) :].tolist()
    return tokenizer.decode(out[: out.index(tokenizer.eos_id)] if tokenizer.eos_id in out else out)


def completion(prompt: list[int], new: list[int], eos: int) -> dict:
    """A sample as a row: tokens (eos kept), new tokens, whether it ended."""
    ended = bool(new) and new[-1] == eos
    return {"prompt_len": len(prompt), "tokens": prompt + new, "text_ids": new[:-1] if ended else new, "terminated": ended, "n_new": len(new)}


def sample_groups(prompts: DataFrame, provider: Provider, tokenizer: BpeTokenizer, *, group_size: int, max_new: int, temperature: float = 1.0, top_k: int | None = None, seed: int = 0) -> DataFrame:
    """Completions of (group, ids array<int>) prompts: group, sample, prompt_len, tokens, text,
    terminated, n_new. A group's draws depend on seed + group alone, so a lost task is redone
    alike. The provider is broadcast; its size is that of a model."""
    shared = prompts.sparkSession.sparkContext.broadcast((provider, tokenizer))

    def run(batches):
        model, coder = shared.value
        for batch in batches:
            groups, prompts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = generate_all(model, prompts, max_new=max_new, eos=coder.eos_id, copies=group_size, seeds=[seed + g for g in groups], temperature=temperature, top_k=top_k)
            for group, ids, samples in zip(groups, prompts, found, strict=True):
                rows = [completion(ids, new, coder.eos_id) for new in (samples if group_size > 1 else [samples])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "group": [group] * len(rows), "sample": list(range(len(rows))), "prompt_len": [r["prompt_len"] for r in rows], "tokens": [r["tokens"] for r in rows],
                        "text": [coder.decode(r["text_ids"]) for r in rows], "terminated": [r["terminated"] for r in rows], "n_new": [r["n_new"] for r in rows],
                    },
                    schema=pa.schema([("group", pa.int64()), ("sample", pa.int32()), ("prompt_len", pa.int32()), ("tokens", pa.list_(pa.int32())), ("text", pa.string()), ("terminated", pa.bool_()), ("n_new", pa.int32())]),
                )

    return prompts.select("group", "ids").mapInArrow(run, "group bigint, sample int, prompt_len int, tokens array<int>, text string, terminated boolean, n_new int")


def token_logprobs(provider: Provider, seqs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log p of each actual next token, and the shifted mask."""
    return target_logprobs(provider, seqs[:, :-1], seqs[:, 1:]), mask[:, 1:]
