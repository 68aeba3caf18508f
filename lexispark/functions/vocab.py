"""Special tokens, the byte alphabet, the pre-tokenising pattern and byte-level ids."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.functions.arrays import let

# The special tokens in the order of their ids 0..7.
SPECIAL_TOKENS = ["<|pad|>", "<|bos|>", "<|eos|>", "<|system|>", "<|user|>", "<|assistant|>", "<|tool_call|>", "<|tool_result|>"]
PAD, BOS, EOS = 0, 1, 2
ROLE_IDS = {"system": 3, "user": 4, "assistant": 5, "tool": 7}
# Fixed value: the split of byte-level BPE; (?U) makes \s, \p{L} and \p{N} Unicode classes.
PRETOKEN_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCAB_SIZE = 32_768


def byte_alphabet() -> list[tuple[int, str, int]]:
    """(byte, stand-in character, id): printable bytes stand for themselves, the others for
    the characters from U+0100 on; ids follow the stand-ins' code points after the specials."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    stand_in = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    order = sorted(range(256), key=lambda b: ord(stand_in[b]))
    rank = {b: i for i, b in enumerate(order)}
    return [(b, stand_in[b], len(SPECIAL_TOKENS) + rank[b]) for b in range(256)]


def byte_id(b: Column) -> Column:
    """Id of a byte value, from the ranges of the alphabet (no lookup table)."""
    return (
        F.when(b.between(33, 126), b - 33)
        .when(b.between(161, 172), b - 67)
        .when(b.between(174, 255), b - 68)
        .when(b <= 32, b + 188)
        .when(b.between(127, 160), b + 94)
        .otherwise(F.lit(255))
        + len(SPECIAL_TOKENS)
    ).cast("int")


def byte_ids(text: Column) -> Column:
    """array<int> of a text's byte-level ids; null counts as empty. Literal special strings are
    bytes like any others, so no text can smuggle in a special token.

    An Arrow function that looks up a whole batch's bytes at once: about a nanosecond a byte,
    where the expression ``byte_ids_expression`` takes hundreds.
    """
    return _encode_bytes(text)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _encode_bytes(texts: pa.Array) -> pa.Array:
    return _ids_of(texts)


def ids_of(texts: pa.Array) -> pa.Array:
    """``byte_ids`` of an Arrow array."""
    return _ids_of(texts)


def _ids_of(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    content = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(_id_of_byte()[content]))


def byte_ids_expression(text: Column) -> Column:
    """``byte_ids`` as a JVM expression, for short texts or where Python is not wanted."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    byte = lambda d, i: F.conv(F.hex(F.substring(d, i, F.lit(1))), 16, 10).cast("int")
    ids = let(data, lambda d: F.transform(F.sequence(F.lit(1), F.octet_length(d)), lambda i: byte_id(byte(d, i))))
    return F.when(F.octet_length(F.coalesce(text, F.lit(""))) == 0, F.array().cast("array<int>")).otherwise(ids)


def byte_text(ids: Column) -> Column:
    """The text of byte-level ids; specials are dropped, invalid UTF-8 is replaced."""
    return _decode_bytes(ids)


@F.arrow_udf(T.StringType())
def _decode_bytes(lists: pa.Array) -> pa.Array:
    return _text_of(lists)


def _text_of(lists: pa.Array) -> pa.Array:
    table = _byte_of_id()
    out = []
    for ids in lists:
        values = np.asarray(ids.values) if ids.is_valid else np.empty(0, np.int64)
        out.append(table[values[values >= len(SPECIAL_TOKENS)] - len(SPECIAL_TOKENS)].tobytes().decode("utf-8", "replace"))
    return pa.array(out, pa.string())


#: Bytes of text that one step of a round trip encodes; only a single longer text takes more.
STEP_BYTES = 1 << 20


def byte_slices(texts: pa.Array, step: int | None = None) -> Iterator[pa.Array]:
    """A text column in slices of up to ``step`` bytes, at least one row each."""
    step = step or STEP_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + step, side="right")))
        yield texts.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def round_trips(df: DataFrame, text: str = "text") -> DataFrame:
    """One row (n_docs, n_same): texts, and those that encoding with bos and eos and decoding returns
    unchanged; null counts as empty. Ids are made for ``STEP_BYTES`` of text at a time and never leave their step, so
    a task's memory does not grow with the rows of a batch."""

    def run(batches):
        n = same = 0
        for batch in batches:
            for texts in byte_slices(batch.column(0)):
                ids = _ids_of(texts)
                # a row's ids and its specials, in the order bos, ids, eos
                lengths = ids.value_lengths().to_numpy() + 2
                ends = np.cumsum(lengths)
                values = np.empty(int(ends[-1]), np.int32)
                inner = np.ones(len(values), bool)
                inner[ends - lengths] = inner[ends - 1] = False
                values[ends - lengths], values[ends - 1], values[inner] = BOS, EOS, ids.flatten().to_numpy()
                whole = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))
                same += pc.sum(pc.equal(_text_of(whole), pc.fill_null(texts, "").cast(pa.string()))).as_py() or 0
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([same], pa.int64())], names=["n_docs", "n_same"])

    counted = df.select(text).mapInArrow(run, "n_docs bigint, n_same bigint")
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_docs", "n_same")])


@lru_cache(maxsize=1)
def _id_of_byte() -> np.ndarray:
    return np.array([i for _, _, i in byte_alphabet()], dtype=np.int32)


@lru_cache(maxsize=1)
def _byte_of_id() -> np.ndarray:
    return np.array([b for b, _, _ in sorted(byte_alphabet(), key=lambda row: row[2])], dtype=np.uint8)


def byte_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, n): how often each byte-level id occurs. Batches are counted before the shuffle,
    which so holds at most 256 rows a batch."""

    def run(batches):
        for batch in batches:
            column = pc.fill_null(batch.column(0).cast(pa.large_string()), "").cast(pa.large_binary())
            data = b"".join(column.to_pylist())
            n = np.bincount(_id_of_byte()[np.frombuffer(data, np.uint8)], minlength=256 + len(SPECIAL_TOKENS))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["token", "n"])

    counted = df.select(text).mapInArrow(run, "token int, n bigint")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def with_specials(ids: Column, *, bos: bool = False, eos: bool = False) -> Column:
    parts = [F.array(F.lit(BOS))] * bos + [ids] + [F.array(F.lit(EOS))] * eos
    return F.concat(*parts)


def pretokens(text: Column) -> Column:
    """Byte-level pre-tokens of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PRETOKEN_PATTERN), F.lit(0))


def special_tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(SPECIAL_TOKENS)], "id int, token string")


def fingerprint(tokens: list[str], merges: list[tuple[str, str]]) -> str:
    """SHA-256 of the canonical JSON of a vocabulary and its merges."""
    body = json.dumps({"merges": [list(m) for m in merges], "vocab": tokens}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()
