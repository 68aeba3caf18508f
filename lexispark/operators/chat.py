"""Conversations: rendering with loss masks, next-fit packing, shifts, micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.vocab import BOS, EOS, PAD, ROLE_IDS, byte_ids, ids_of
from lexispark.operators import nextfit

IGNORE_INDEX = -100
PAD_SEGMENT = -1
#: Windows of a batch that ``supervised_windows`` hands on, at least, if there are as many.
WINDOWS_AT_A_TIME = 1024


def role_id(role: Column) -> Column:
    """Header id of a role; an unknown role fails the query."""
    known = None
    for name, i in ROLE_IDS.items():
        known = F.when(role == name, F.lit(i)) if known is None else known.when(role == name, F.lit(i))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))).cast("int"))


def turn_ids(role: Column, content_ids: Column) -> Column:
    """A turn as (id, mask) structs: header, content, eos; an assistant's content and eos are supervised."""
    on = F.when(role == "assistant", F.lit(1)).otherwise(F.lit(0))
    pair = lambda i, m: F.struct(i.cast("int").alias("id"), m.cast("int").alias("mask"))
    return F.concat(F.array(pair(role_id(role), F.lit(0))), F.transform(content_ids, lambda i: pair(i, on)), F.array(pair(F.lit(EOS), on)))


def render(turns: DataFrame, *, generation_prompt: bool = False, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", ids: Column | None = None) -> DataFrame:
    """(key, tokens array<struct<id, mask>>): bos, then the turns in order, then optionally an
    empty assistant header. A conversation is one row, so it must fit in memory; conversations
    are dealt by key. ``ids`` gives the content's ids; byte-level ones by default."""
    one = turns.select(key, turn, turn_ids(F.col(role), byte_ids(F.col(text)) if ids is None else ids).alias("t"))
    ordered = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), "t"))).alias("turns"))
    body = F.flatten(F.transform("turns", lambda x: x["t"]))
    single = lambda i: F.array(F.struct(F.lit(i).alias("id"), F.lit(0).alias("mask")))
    parts = [single(BOS), body] + [single(ROLE_IDS["assistant"])] * generation_prompt
    return ordered.select(key, F.concat(*parts).alias("tokens"))


def render_messages(conversations: DataFrame, *, key: str = "conv_id", messages: str = "messages", **options) -> DataFrame:
    """``render`` for rows holding ``messages array<struct<role, content>>``."""
    turns = conversations.select(key, F.posexplode(messages).alias("turn", "m")).select(key, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))
    return render(turns, key=key, **options)


def _rendered(turns: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one conversation, as in ``render``, of its (n, head, text) in order of n."""
    heads, ids = turns.field("head").to_numpy(), ids_of(turns.field("text"))
    numbers = turns.field("n").to_pylist()
    if len(set(numbers)) < len(numbers):  # turns of one number go by their ids
        same = [[i for i, _ in g] for _, g in groupby(enumerate(numbers), lambda x: x[1])]
        order = [i for g in same for i in sorted(g, key=lambda i: (heads[i], ids[i].as_py()))]
        heads, ids = heads[order], ids.take(pa.array(order))
    lengths = ids.value_lengths().to_numpy() + 2
    ends = np.cumsum(lengths) + 1
    first = ends - lengths
    tokens, mask, inner = np.empty(ends[-1], np.int32), np.zeros(ends[-1], np.int32), np.ones(ends[-1], bool)
    inner[0] = inner[first] = inner[ends - 1] = False
    tokens[0], tokens[first], tokens[ends - 1], tokens[inner] = BOS, heads, EOS, ids.flatten().to_numpy()
    mask[1:] = np.repeat(heads == ROLE_IDS["assistant"], lengths)
    mask[first] = 0
    return tokens, mask


def supervised_windows(turns: DataFrame, size: int, tasks: int, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(inputs, targets, mask), lists of ``size``: windows over what ``render`` gives, each token but a conversation's
    first being a target once. Windows without a supervised target are left out; a last one is padded.

    Conversations are dealt by key to ``tasks`` tasks, which cut them where they are: texts are shuffled, tokens never.
    """
    one = turns.select(key, F.struct(F.col(turn).alias("n"), role_id(F.col(role)).alias("head"), F.col(text).alias("text")).alias("t"))
    ordered = one.repartition(tasks, key).groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("turns")).select("turns")

    def windows(batches) -> Iterator[np.ndarray]:
        for batch in batches:
            column = batch.column(0)
            offsets = column.offsets.to_numpy()
            for at, end in zip(offsets, offsets[1:]):
                tokens, mask = _rendered(column.values.slice(at, end - at))
                n = -(-(len(tokens) - 1) // size) * size + 1
                tokens, mask = np.pad(tokens, (0, n - len(tokens)), constant_values=PAD), np.pad(mask, (0, n - len(mask)))
                cut = np.stack([x.reshape(-1, size) for x in (tokens[:-1], tokens[1:], mask[1:])])
                yield cut[:, cut[2].any(1)]

    def batch_of(parts: list[np.ndarray]) -> pa.RecordBatch:
        offsets = pa.array(np.arange(sum(x.shape[1] for x in parts) + 1, dtype=np.int32) * size)
        columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[i] for x in parts]).ravel())) for i in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["inputs", "targets", "mask"])

    def run(batches):
        parts: list[np.ndarray] = []
        for found in windows(batches):
            parts.append(found)
            if sum(x.shape[1] for x in parts) >= WINDOWS_AT_A_TIME:
                yield batch_of(parts)
                parts = []
        if parts:
            yield batch_of(parts)

    return ordered.mapInArrow(run, "inputs array<int>, targets array<int>, mask array<int>")


def next_fit(lengths: DataFrame, capacity: int, *, key: str = "conv_id", length: str = "n", **sizes) -> DataFrame:
    """Sequential next-fit in key order: (key, n, row, start, segment).

    A conversation longer than the capacity is truncated to it. Only keys and lengths are moved; where one
    conversation goes depends on all before it, which ``operators.nextfit`` settles in parallel.
    """
    return nextfit.next_fit(lengths, capacity, key=key, length=length, **sizes)


def pack_conversations(rendered: DataFrame, seq_len: int, *, key: str = "conv_id") -> DataFrame:
    """Rows of seq_len + 1 tokens by next-fit, shifted: row, input_ids, targets, loss_mask,
    segment_ids. The mask follows the target, segments follow the input."""
    capacity = seq_len + 1
    placed = next_fit(rendered.select(key, F.size("tokens").alias("n")), capacity, key=key)
    joined = placed.join(rendered, key).select("row", "start", "segment", F.slice("tokens", F.lit(1), F.col("n")).alias("tokens"))
    rows = joined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "segment", "tokens"))).alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: F.transform(p["tokens"], lambda t: F.struct(t["id"].alias("id"), t["mask"].alias("mask"), p["segment"].alias("segment")))))
    filled = rows.select("row", flat.alias("t"))
    pad = lambda value: F.array_repeat(F.lit(value), capacity - F.size("t"))
    part = lambda name, value: F.concat(F.transform("t", lambda x: x[name]), pad(value))
    padded = filled.select("row", part("id", PAD).alias("ids"), part("mask", 0).alias("mask"), part("segment", PAD_SEGMENT).alias("segments"))
    first, second = (lambda c: F.slice(c, 1, seq_len)), (lambda c: F.slice(c, 2, seq_len))
    return padded.select("row", first("ids").alias("input_ids"), second("ids").alias("targets"), second("mask").alias("loss_mask"), first("segments").alias("segment_ids"))


def microbatches(rows: DataFrame, size: int, *, row: str = "row") -> DataFrame:
    """Consecutive chunks of rows; the last may be short."""
    return rows.withColumn("microbatch", F.expr(f"{row} div {size}"))


def masked_targets(targets: Column, mask: Column) -> Column:
    return F.zip_with(targets, mask, lambda t, m: F.when(m == 0, F.lit(IGNORE_INDEX)).otherwise(t))


def collate(completions: DataFrame, *, tokens: str = "tokens", prompt_len: str = "prompt_len", pad: int = PAD) -> DataFrame:
    """Pad all sequences to the longest; the mask is true on generated tokens."""
    longest = completions.agg(F.max(F.size(tokens)).alias("longest"))
    both = completions.join(F.broadcast(longest))  # a single row
    n, whole = F.size(tokens), F.col("longest")
    padded = F.concat(F.col(tokens), F.array_repeat(F.lit(pad), whole - n))
    mask = F.transform(F.sequence(F.lit(0), whole - 1), lambda i: (i >= F.col(prompt_len)) & (i < n))
    return both.withColumn("seq", padded).withColumn("comp_mask", mask).drop("longest")


def to_matrix(rows: DataFrame, column: str) -> np.ndarray:
    """A packed column as a matrix, in row order, for the numerical code on the driver."""
    return np.array([r[0] for r in rows.orderBy("row").select(column).collect()], dtype=np.int64)
