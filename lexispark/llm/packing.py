"""Harmonic packing of tokenised documents into fixed-length sequences (operator 6).

A document's ids are cut into whole sequences of ``capacity`` ids and a rest; the rest is cut
greedily into class sizes capacity // k (k = 1, 2, 3, ...), of which there are about
2 * sqrt(capacity). Each cut leaves less than a k-th of what it took, so a rest takes three or
four pieces. Bins of a class hold a fixed count of pieces, capacity // size, and are full but
for capacity mod size ids.

Workers number their pieces of each class on their own; a prefix sum of the (worker, class)
counts - no row of a document is moved for it - gives every worker its first place, and place
div count is the bin. Only the last, incomplete bin of each class is left; these pieces, at
most about ``capacity * ln(capacity)`` whatever the input's size, are put together by first-fit
decreasing in one task.

Special tokens that a text spells out are single ids, as the library reads them.

Edge cases: a null or empty text has the end id alone; rows are packed one by one, so repeated
rows and null keys are packed like any others; pieces of equal length keep the order of their
workers and rows; an empty table gives no pieces; a very long text is cut like any other; extra
columns, whatever their names, are ignored. A sequence is padded to the capacity unless its length is a power
of two, see ``padding``.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import WORKER_CACHE, map_rows, materialize

CAPACITY = 4096
END_ID = 2
#: Words whose ids a Python worker remembers; characters of text handled at a time.
CACHE_WORDS = 800_000
CHUNK_CHARS = 400_000


# --- tokenising --------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _latin_words() -> re.Pattern:
    """The tokenizer's split for lower-cased texts of characters below U+0180.

    Fixed by the tokenizer's file: contractions, runs of letters, single digits, runs of
    anything else that is not white space. Classes are spelled out for the range.
    """
    kinds = {"L": [], "N": []}
    for code in range(0x180):
        if (kind := unicodedata.category(chr(code))[0]) in kinds:
            kinds[kind].append(re.escape(chr(code)))
    letter, number = "".join(kinds["L"]), "".join(kinds["N"])
    space = r"\x09-\x0d\x20\x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


#: Texts with other characters, with a capital whose lower case has a second character, or with
#: separators that Python alone takes for white space go through the tokenizer as a whole.
_OTHER = re.compile("[^\x00-ſ]|İ|[\x1c-\x1f]")


def needs_whole(text: str) -> bool:
    """Whether a text must go through the tokenizer as a whole. Most texts are settled by a copy
    into Latin-1, which is much faster than the pattern."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _OTHER.search(text) is not None
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


class WordTokenizer:
    """Ids of a word-level BPE tokenizer, with the ids of seen words remembered.

    The split never crosses white space, so what stands between white space can be looked up
    as one.
    """

    def __init__(self, data: bytes):
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        self.tokenizer = tokenizers.Tokenizer.from_str(data.decode("utf-8"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def learn(self, tokens: set[str]) -> None:
        """Remember the ids of what stands between white space: of its matches, in order."""
        new = list(tokens.difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            self.matches.clear()
            new = list(tokens)
        split = _latin_words().findall
        parts = list(map(split, new))
        self.learn_matches(list(set(chain.from_iterable(parts)).difference(self.matches)))
        get = self.matches.__getitem__
        self.known.update((token, get(own[0]) if len(own) == 1 else b"".join(map(get, own))) for token, own in zip(new, parts, strict=True))

    def learn_matches(self, new: list[str]) -> None:
        """Encode matches in few calls; the ids of a match end with its only end-of-word token."""
        if not new:
            return
        texts = [" ".join(new[at : at + 500]) for at in range(0, len(new), 500)]
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.asarray(c.ids, dtype="<u4") for c in coded])
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(new):
            raise ValueError("the tokenizer splits words differently than its pattern says")
        raw, at = ids.tobytes(), 0
        for match, stop in zip(new, stops, strict=True):
            self.matches[match] = raw[at:stop]
            at = stop

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian 32-bit words, without special tokens."""
        out, pending, size = [], [], 0

        def flush():
            nonlocal pending, size
            self.learn(set().union(*(words for words in pending if type(words) is list)))
            get = self.known.__getitem__
            out.extend(b"".join(map(get, words)) if type(words) is list else words for words in pending)
            pending, size = [], 0

        for text in texts:
            text = text or ""
            if needs_whole(text) or any(token in text for token in self.special):
                pending.append(np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
            else:
                pending.append(text.lower().split())
            size += len(text)
            if size >= CHUNK_CHARS:
                flush()
        flush()
        return out


def word_tokenizer(data: bytes) -> WordTokenizer:
    key = ("word_bpe", hashlib.sha256(data).hexdigest())
    if key not in WORKER_CACHE:
        WORKER_CACHE[key] = WordTokenizer(data)
    return WORKER_CACHE[key]


# --- classes -----------------------------------------------------------------------------


@lru_cache(maxsize=4)
def class_sizes(capacity: int = CAPACITY) -> list[int]:
    """The distinct values of capacity // k, ascending: 1 is the first, capacity the last."""
    return sorted({capacity // k for k in range(1, capacity + 1)})


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece sizes of a document of n ids: whole sequences, then ever smaller classes."""
    sizes = class_sizes(capacity)
    pieces = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        size = sizes[bisect_right(sizes, rest) - 1]
        pieces.append(size)
        rest -= size
    return pieces


def padding(length: int, capacity: int = CAPACITY) -> int:
    """Pad ids that a sequence of so many ids gets."""
    return 0 if length & (length - 1) == 0 else capacity - length


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; equal lengths keep their order."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    used: list[int] = []
    first_open = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = next((b for b in range(first_open, len(used)) if used[b] + n <= capacity), len(used))
        if at == len(used):
            used.append(0)
        placed[i] = (at, used[at])
        used[at] += n
        while first_open < len(used) and used[first_open] == capacity:
            first_open += 1
    return placed


# --- the plan ----------------------------------------------------------------------------


def cut_documents(docs: DataFrame, vocabulary: bytes, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its worker's number and its place among the worker's class."""
    data = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["start", "length", "ids_crc32", "doc_tokens", "part", "place"] + ["ids"] * with_ids
    schema = f"{key} {dict(docs.dtypes)[key]}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, place bigint" + ", ids array<int>" * with_ids

    def make():
        tokenizer, part, counts = word_tokenizer(data.value), TaskContext.get().partitionId(), {}

        def step(rows):
            out = {name: [] for name in [key, *names]}
            for doc, ids in zip(rows[key], tokenizer.encode_batch(rows[text]), strict=True):
                ids += end
                start, total = 0, len(ids) // 4
                for n in cut(total, capacity):
                    place = counts.get(n, 0)
                    counts[n] = place + 1
                    piece = ids[4 * start : 4 * (start + n)]
                    for name, value in zip([key, *names], (doc, start, n, zlib.crc32(piece), total, part, place), strict=False):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(np.frombuffer(piece, dtype="<u4").astype("<i4"))
                    start += n
            return out

        return step

    return map_rows(docs.select(key, text), schema, make)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces of (length, part, place)."""
    counts = pieces.groupBy("length", "part").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # One row per class, of which there are at most 2 * sqrt(capacity): safe to broadcast.
    totals = counts.groupBy("length").agg(F.sum("n").alias("total"))
    fit = F.expr(f"{capacity} div length")
    ranked = (
        pieces.join(firsts, ["length", "part"])
        .join(F.broadcast(totals), "length")
        .withColumn("bin", F.expr(f"(first + place) div ({capacity} div length)"))
        .withColumn("offset", ((F.col("first") + F.col("place")) % fit) * F.col("length"))
        .withColumn("full", (F.col("bin") + 1) * fit <= F.col("total"))
    )
    keep = [c for c in pieces.columns if c not in ("part", "place")]
    full = ranked.where("full").select(*keep, F.expr("shiftleft(length, 44) + bin").alias("sequence_id"), "offset")
    rest = ranked.where("NOT full").select(*keep, "part", "place")

    def fill(pdf):
        pdf = pdf.sort_values(["length", "part", "place"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        at = first_fit_decreasing(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = [(1 << 60) + b for b, _ in at]
        pdf["offset"] = [o for _, o in at]
        return pdf[[*keep, "sequence_id", "offset"]]

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes if n in keep) + ", sequence_id bigint, offset bigint"
    # A single group: the incomplete bins, whose pieces are bounded by the capacity alone.
    return full.unionByName(rest.groupBy((F.col("length") * 0).alias("pool")).applyInPandas(fill, schema))


def pack_documents(docs: DataFrame, vocabulary: bytes, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and where they go: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids themselves on request."""
    pieces = cut_documents(docs, vocabulary, key=key, text=text, capacity=capacity, end_id=end_id, with_ids=with_ids)
    return place_pieces(materialize(pieces, "pieces"), capacity)
