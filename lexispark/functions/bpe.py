"""Byte-level BPE with a trained vocabulary: learning merges, encoding, decoding, storage."""

from __future__ import annotations

import heapq
import json
from collections import Counter, defaultdict
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.functions.vocab import PRETOKEN_PATTERN, SPECIAL_TOKENS, byte_alphabet, byte_ids, fingerprint, pretokens
from lexispark.session import store

Pair = tuple[int, int]


@lru_cache(maxsize=1)
def _stand_in() -> dict[int, str]:
    return {b: c for b, c, _ in byte_alphabet()}


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    return {c: b for b, c, _ in byte_alphabet()}


def base_tokens() -> list[str]:
    """Specials, then the byte alphabet: the ids before any merge."""
    return SPECIAL_TOKENS + [c for _, c, _ in sorted(byte_alphabet(), key=lambda row: row[2])]


class BpeTokenizer:
    """Tokens in id order and merges in rank order, as strings of byte stand-ins."""

    def __init__(self, tokens: list[str], merges: list[tuple[str, str]]):
        lacking = [t for t in SPECIAL_TOKENS if t not in set(tokens)]
        if lacking:
            raise ValueError(f"missing required tokens: {lacking}")
        self.tokens, self.merges = list(tokens), [tuple(m) for m in merges]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.special_ids = {self.ids[t] for t in SPECIAL_TOKENS}
        self.ranks = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(self.merges)}
        self._known: dict[str, list[int]] = {}
        self._split = None
        self._bytes: tuple[dict[int, bytes], dict[int, bytes]] = {}, {}

    def __getstate__(self):
        return {"tokens": self.tokens, "merges": self.merges}

    def __setstate__(self, state):
        self.__init__(state["tokens"], state["merges"])

    @property
    def vocab_size(self) -> int:
        return len(self.tokens)

    pad_id, bos_id, eos_id = (property(lambda self, t=t: self.ids[t]) for t in ("<|pad|>", "<|bos|>", "<|eos|>"))

    def token_to_id(self, token: str) -> int | None:
        return self.ids.get(token)

    def fingerprint(self) -> str:
        return fingerprint(self.tokens, self.merges)

    def encode_word(self, word: str) -> list[int]:
        """Merge adjacent ids by lowest rank until none is left."""
        known = self._known.get(word)
        if known is not None:
            return known
        ids = [self.ids[_stand_in()[b]] for b in word.encode("utf-8", "surrogatepass")]
        while len(ids) > 1:
            found = [(self.ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
            if not found:
                break
            rank = min(found)[0]
            out, i = [], 0
            while i < len(ids):
                entry = self.ranks.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if entry and entry[0] == rank:
                    out.append(entry[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        if len(self._known) >= 200_000:
            self._known.clear()
        self._known[word] = ids
        return ids

    def split(self, text: str) -> list[str]:
        if self._split is None:
            import regex

            self._split = regex.compile(PRETOKEN_PATTERN.removeprefix("(?U)")).findall
        return self._split(text)

    def encode(self, text: str, *, add_bos: bool = False, add_eos: bool = False, allow_special: bool = False) -> list[int]:
        """Ids of a text. Literal special strings are ordinary text unless ``allow_special``."""
        parts = [text]
        if allow_special:
            import re

            parts = re.split("(" + "|".join(map(re.escape, SPECIAL_TOKENS)) + ")", text)
        ids = [self.bos_id] * add_bos
        for part in parts:
            if allow_special and part in SPECIAL_TOKENS:
                ids.append(self.ids[part])
            else:
                for word in self.split(part):
                    ids.extend(self.encode_word(word))
        return ids + [self.eos_id] * add_eos

    def decode(self, ids, *, skip_special: bool = True) -> str:
        """Text of ids; ids outside the vocabulary say nothing, invalid UTF-8 is replaced."""
        known, out = self._bytes[skip_special], []
        for i in ids:
            piece = known.get(i)
            if piece is None:
                piece = known[i] = self._spelled(int(i), skip_special)
            out.append(piece)
        return b"".join(out).decode("utf-8", "replace")

    def _spelled(self, i: int, skip_special: bool) -> bytes:
        if not 0 <= i < len(self.tokens):
            return b""
        if i in self.special_ids:
            return b"" if skip_special else self.tokens[i].encode()
        return bytes(_byte_of()[c] for c in self.tokens[i])

    def to_public_json(self) -> str:
        """The vocabulary in the layout of a ``tokenizer.json`` file of the public library."""
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        flags = dict.fromkeys(("single_word", "lstrip", "rstrip", "normalized"), False) | {"special": True}
        model = {
            "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
            "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": dict(self.ids), "merges": [list(m) for m in self.merges],
        }
        added = [{"id": i, "content": self.tokens[i]} | flags for i in sorted(self.special_ids)]
        return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": byte_level, "post_processor": None, "decoder": byte_level, "model": model}, ensure_ascii=False)

    @classmethod
    def from_public_json(cls, text: str) -> BpeTokenizer:
        """A byte-level BPE from such a file; merges may be pairs or space-joined."""
        record = json.loads(text)
        model = record["model"]
        if model.get("type", "BPE") != "BPE" or record.get("normalizer") or (record.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE without normaliser")
        ids = dict(model["vocab"]) | {t["content"]: t["id"] for t in record.get("added_tokens", [])}
        tokens = sorted(ids, key=ids.get)
        if [ids[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError("the vocabulary's ids have gaps")
        return cls(tokens, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def to_json(self) -> str:
        return json.dumps({"tokens": self.tokens, "merges": self.merges}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> BpeTokenizer:
        record = json.loads(text)
        return cls(record["tokens"], [tuple(m) for m in record["merges"]])

    def save(self, spark: SparkSession, path: str) -> None:
        """Vocabulary and merges as one JSON line at any path that Spark can write."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BpeTokenizer:
        return cls.from_json(spark.read.text(path).first()[0])

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "id int, token string")

    def encode_column(self, text: Column, *, eos: bool = False) -> Column:
        """array<int> of a text column, encoded in Arrow batches."""
        coder = self

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encoded(texts: pa.Array) -> pa.Array:
            return pa.array([coder.encode(t or "", add_eos=eos) for t in texts.to_pylist()], pa.list_(pa.int32()))

        return encoded(text)

    def decode_column(self, ids: Column) -> Column:
        coder = self

        @F.arrow_udf(T.StringType())
        def decoded(lists: pa.Array) -> pa.Array:
            return pa.array([coder.decode(x or []) for x in lists.to_pylist()], pa.string())

        return decoded(ids)


# --- learning merges ---------------------------------------------------------------------


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): pre-tokens of all documents and how often they occur; the corpus is read once."""
    return docs.select(F.explode(pretokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(words: DataFrame, min_frequency: int = 2) -> DataFrame:
    """(a, b, n): adjacent byte-level ids in (word, n) rows, weighted by the words' counts, where
    frequent enough: the first step of learning merges."""
    ids = words.select("n", byte_ids("word").alias("ids")).where(F.size("ids") > 1)
    zipped = F.arrays_zip(F.slice("ids", F.lit(1), F.size("ids") - 1).alias("a"), F.slice("ids", F.lit(2), F.size("ids") - 1).alias("b"))
    pairs = ids.select("n", F.explode(zipped).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).where(F.col("n") >= min_frequency)


#: A pair at less than one in so many places of the array has few; after so many of these, merges are made word by
#: word. Listing the words of each pair, which that needs, costs as much as hundreds of passes over the array.
FEW_PLACES = 512
PATIENCE = 1000


class Spelled:
    """Ids of all words in one array, with -1 before, between and behind them; merges are made everywhere at once."""

    def __init__(self, counts: dict[str, int]):
        encoded = [w.encode("utf-8", "surrogatepass") for w in counts]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.weight = np.fromiter(counts.values(), np.int64, len(encoded))
        self.word = np.repeat(np.arange(len(encoded), dtype=np.int32), lengths + 1)
        self.word = np.r_[self.word, self.word[-1:]] if len(encoded) else np.zeros(1, np.int32)
        self.ids = np.full(int(lengths.sum()) + len(encoded) + 1, -1, np.int32)
        inside = np.arange(int(lengths.sum())) + np.repeat(np.arange(1, len(encoded) + 1), lengths)
        id_of = np.array([i for _, _, i in byte_alphabet()], np.int32)
        self.ids[inside] = id_of[np.frombuffer(b"".join(encoded), np.uint8)]

    def _counted(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a << 32 | b, n) of the pairs that begin at some places, weighted by their words' counts."""
        a, b = self.ids[edges].astype(np.int64), self.ids[edges + 1].astype(np.int64)
        real = (a >= 0) & (b >= 0)
        key, which = np.unique((a[real] << 32) | b[real], return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, which, self.weight[self.word[edges[real]]])
        return key, n

    def pairs(self) -> Counter[Pair]:
        found: Counter[Pair] = Counter()
        for low in range(0, len(self.ids) - 1, 1 << 20):
            for key, n in zip(*map(np.ndarray.tolist, self._counted(np.arange(low, min(low + (1 << 20), len(self.ids) - 1)))), strict=True):
                found[key >> 32, key & 0xFFFFFFFF] += n
        return found

    def places(self, pair: Pair) -> np.ndarray:
        """Where a pair begins, from the left and without overlaps."""
        at = np.flatnonzero(self.ids[:-1] == pair[0])
        at = at[self.ids[at + 1] == pair[1]]
        if pair[0] == pair[1] and len(at):  # of a run of one id every other place
            starts = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        return at

    def merge(self, at: np.ndarray, new: int) -> dict[Pair, int]:
        """Put ``new`` for the pairs at some places; the changes of pairs' counts."""
        apart = np.r_[True, np.diff(at) != 2]  # not right behind another one, with which it shares a pair
        changes: Counter[Pair] = Counter()
        old = self._counted(np.concatenate([at[apart] - 1, at, at + 1]))
        self.ids[at] = new
        keep = np.ones(len(self.ids), bool)
        keep[at + 1] = False
        self.ids, self.word = self.ids[keep], self.word[keep]
        now = at - np.arange(len(at))
        for sign, (keys, n) in ((-1, old), (1, self._counted(np.concatenate([now[apart] - 1, now])))):
            for key, times in zip(keys.tolist(), n.tolist(), strict=True):
                changes[key >> 32, key & 0xFFFFFFFF] += sign * times
        return changes

    def words(self) -> list[list[int]]:
        ends = np.flatnonzero(self.ids < 0)
        flat = self.ids.tolist()
        return [flat[a + 1 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def learn_merges(counts: dict[str, int], vocab_size: int, min_frequency: int = 2) -> BpeTokenizer:
    """Merge the most frequent adjacent pair until the vocabulary is full or no pair is frequent
    enough; of equally frequent pairs the one with the lowest ids comes first.

    Pair counts are kept up to date. The first merges are in a good part of all words, and are made in
    one array of all of them at once; after ``PATIENCE`` merges at few places, a merge touches only the words that
    hold its pair.
    """
    tokens = base_tokens()
    ids = {t: i for i, t in enumerate(tokens)}
    spelled, few = Spelled(counts), 0
    pairs: Counter[Pair] = spelled.pairs()
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while heap and len(tokens) < vocab_size:
        count, pair = heapq.heappop(heap)
        now = pairs.get(pair, 0)
        if now != -count:
            if now > 0:
                heapq.heappush(heap, (-now, pair))
            continue
        if now < max(1, min_frequency):
            break
        at = spelled.places(pair)
        few += len(at) * FEW_PLACES < len(spelled.ids)
        if few > PATIENCE:
            heapq.heappush(heap, (count, pair))
            break
        joined = tokens[pair[0]] + tokens[pair[1]]
        merges.append((tokens[pair[0]], tokens[pair[1]]))
        new = ids.get(joined)
        if new is None:
            new = ids[joined] = len(tokens)
            tokens.append(joined)
        changes = spelled.merge(at, new)
        pairs.pop(pair, None)
        for p, change in changes.items():
            if p != pair and change:
                pairs[p] += change
                if pairs[p] > 0:
                    heapq.heappush(heap, (-pairs[p], p))
    if not heap or len(tokens) >= vocab_size:
        return BpeTokenizer(tokens, merges)

    words, weight = spelled.words(), spelled.weight.tolist()
    holders: defaultdict[Pair, set[int]] = defaultdict(set)
    for w, word in enumerate(words):
        for p in zip(word, word[1:], strict=False):
            holders[p].add(w)
    while heap and len(tokens) < vocab_size:
        count, pair = heapq.heappop(heap)
        now = pairs.get(pair, 0)
        if now != -count:
            if now > 0:
                heapq.heappush(heap, (-now, pair))
            continue
        if now < max(1, min_frequency):
            break
        joined = tokens[pair[0]] + tokens[pair[1]]
        merges.append((tokens[pair[0]], tokens[pair[1]]))
        new = ids.get(joined)
        if new is None:
            new = ids[joined] = len(tokens)
            tokens.append(joined)
        touched: set[Pair] = set()
        for w in holders.pop(pair):
            word, merged = words[w], _merged(words[w], pair, new)
            before, after = Counter(zip(word, word[1:], strict=False)), Counter(zip(merged, merged[1:], strict=False))
            for p in before.keys() | after.keys():
                if change := (after[p] - before[p]) * weight[w]:
                    pairs[p] += change
                    touched.add(p)
                (holders[p].add if p in after else holders[p].discard)(w)
            words[w] = merged
        pairs.pop(pair, None)
        for p in touched:
            if p != pair and pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))
    return BpeTokenizer(tokens, merges)


def _merged(word: list[int], pair: Pair, new: int) -> list[int]:
    out, i = [], 0
    while i < len(word):
        if i + 1 < len(word) and (word[i], word[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


#: Distinct words up to which merges are learned on the driver from the counts alone.
DRIVER_WORDS = 2_000_000


def train(docs: DataFrame, vocab_size: int, *, min_frequency: int = 2, text: str = "text") -> BpeTokenizer:
    """Learn a vocabulary from documents.

    The documents are reduced to word counts in Spark. Up to ``DRIVER_WORDS`` distinct words,
    a checked bound, the merges are learned from the collected counts; beyond it every merge is
    a distributed count and a rewrite of the words.
    """
    counts = store(word_counts(docs, text), "word-counts")
    if counts.limit(DRIVER_WORDS + 1).count() <= DRIVER_WORDS:
        found = counts.toArrow()
        return learn_merges(dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True)), vocab_size, min_frequency)
    return learn_merges_distributed(counts, vocab_size, min_frequency)


class PairCounts:
    """Counts of pairs with the most frequent one at hand; of equal counts the lowest ids come first.

    ``floor`` is a bound for the counts of pairs that are not held (0: all are).
    """

    def __init__(self, counts: dict[Pair, int], floor: int = 0):
        self.counts, self.floor = counts, floor
        self.heap = [(-n, p) for p, n in counts.items()]
        heapq.heapify(self.heap)

    def change(self, pair: Pair, by: int) -> None:
        self.counts[pair] = self.counts.get(pair, 0) + by
        heapq.heappush(self.heap, (-self.counts[pair], pair))

    def drop(self, pair: Pair) -> None:
        self.counts.pop(pair, None)

    def first(self, k: int) -> list[tuple[int, Pair]]:
        """Up to k pairs in order, as (count, pair), among those that no pair beyond them can precede."""
        found: dict[Pair, int] = {}
        while self.heap and len(found) < k:
            n, pair = heapq.heappop(self.heap)
            if pair not in found and self.counts.get(pair) == -n and -n > max(0, self.floor):
                found[pair] = -n
            elif -n <= self.floor:
                heapq.heappush(self.heap, (n, pair))
                break
        for pair, n in found.items():
            heapq.heappush(self.heap, (-n, pair))
        return [(n, pair) for pair, n in found.items()]


def _spelled_again(ids: list[int], ranks: dict[Pair, tuple[int, int]]) -> list[int]:
    """All merges applied to ids, lowest rank first."""
    while len(ids) > 1:
        known = [(ranks[p], p) for p in zip(ids, ids[1:], strict=False) if p in ranks]
        if not known:
            break
        (_, new), pair = min(known)
        ids = _merged(ids, pair, new)
    return ids


_POSTING = "step int, a int, b int, change bigint, word bigint, ids array<int>, n bigint"


class PairIndex:
    """Which words hold a pair, for distinct words that stay in Spark.

    A posting is a row (pair, word, spelling, count). The first ones are a table ordered by pair; a merge
    writes postings for the pairs that it brings about, which hold the new token, to a table of
    its own. So the words of a pair are in the tables of the later of its two tokens. Postings of the other pairs
    of a changed word stay as they are: their spelling is brought up to date when they are read, by the merges
    learned since. No merge reads or rewrites words that do not hold its pair.
    """

    def __init__(self, words: DataFrame, ranks: dict[Pair, tuple[int, int]], top: int):
        self.ranks, self.later = dict(ranks), {}
        #: Tokens first made since the first table was written, in order; tokens that were there already and were made again.
        self.since: dict[int, int] = {}
        self.again: set[int] = set()
        found = self._postings(words)
        self.base = store(found.repartitionByRange("a", "b").sortWithinPartitions("a", "b"), "bpe-index")
        totals = self.base.groupBy("a", "b").agg(F.sum("change").alias("n")).orderBy(F.desc("n"), "a", "b").limit(top + 1).collect()
        self.pairs = PairCounts({(r["a"], r["b"]): r["n"] for r in totals[:top]}, totals[top]["n"] if len(totals) > top else 0)
        self.known = {new for _, new in ranks.values()}

    def _postings(self, words: DataFrame) -> DataFrame:
        ranks = self.ranks

        def run(batches):
            for batch in batches:
                rows = []
                for word, ids, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = _spelled_again(ids, ranks)
                    rows += [{"step": -1, "a": p[0], "b": p[1], "change": times * n, "word": word, "ids": ids, "n": n} for p, times in Counter(zip(ids, ids[1:], strict=False)).items()]
                yield pa.RecordBatch.from_pylist(rows, schema=_posting_schema())

        return words.select("word", "ids", "n").mapInArrow(run, _POSTING)

    def holders(self, pairs: list[Pair]) -> DataFrame:
        """(step, word, ids, n): the words of each pair, which is numbered by its step."""
        asked: dict[tuple, list[tuple[int, Pair]]] = {}
        for step, pair in enumerate(pairs):
            asked.setdefault(self._places(pair), []).append((step, pair))
        found = None
        for places, own in asked.items():
            is_pair = lambda pair: (F.col("a") == pair[0]) & (F.col("b") == pair[1])
            which = F
            for step, pair in own:
                which = which.when(is_pair(pair), F.lit(step))
            wanted = reduce(or_, [is_pair(pair) for _, pair in own])
            for table in (t for place in places for t in ([self.base] if place is None else self.later[place])):
                rows = table.where(F.col("ids").isNotNull() & wanted).select(which.alias("step"), "word", "ids", "n")
                found = rows if found is None else found.unionByName(rows)
        return found.dropDuplicates(["step", "word"])

    def _places(self, pair: Pair) -> tuple[int | None, ...]:
        """The tokens in whose tables the pair's postings are, None for the first table."""
        new = [t for t in pair if t in self.since]
        if any(t in self.again for t in pair):  # made twice, so its pairs are in several tables
            return (None, *sorted({t for t in pair if t in self.later}))
        return (max(new, key=self.since.get),) if new else (None,)

    def tried(self, pairs: list[Pair], news: list[int]) -> DataFrame:
        """What merging the pairs one after the other would change, as stored rows: for each step the
        pairs' changes of count, and postings of pairs that a word did not have before."""
        ranks = self.ranks

        def run(batches):
            for batch in batches:
                rows = []
                for step, word, ids, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = _spelled_again(ids, ranks)
                    for j in range(step):
                        ids = _merged(ids, pairs[j], news[j])
                    merged = _merged(ids, pairs[step], news[step])
                    before, after = Counter(zip(ids, ids[1:], strict=False)), Counter(zip(merged, merged[1:], strict=False))
                    for p in before.keys() | after.keys():
                        if by := after[p] - before[p]:
                            new = after[p] and not before[p]
                            rows.append({"step": step, "a": p[0], "b": p[1], "change": by * n, "word": word, "ids": merged if new else None, "n": n})
                yield pa.RecordBatch.from_pylist(rows, schema=_posting_schema())

        return store(self.holders(pairs).mapInArrow(run, _POSTING).coalesce(max(1, self.base.sparkSession.sparkContext.defaultParallelism)), "bpe-round")

    def accept(self, pair: Pair, new: int, table: DataFrame, step: int) -> None:
        """A merge of a round is learned: its postings count from now on."""
        self.ranks[pair] = (len(self.ranks), new)
        if new in self.known:
            self.again.add(new)
        else:
            self.since[new] = len(self.since)
            self.known.add(new)
        self.later.setdefault(new, []).append(table.where(F.col("step") == step))


def _posting_schema() -> pa.Schema:
    ints = pa.list_(pa.int32())
    return pa.schema([("step", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("change", pa.int64()), ("word", pa.int64()), ("ids", ints), ("n", pa.int64())])


#: Pairs whose counts the driver holds.
TOP_PAIRS = 1 << 17


def learn_merges_distributed(counts: DataFrame, vocab_size: int, min_frequency: int = 2, *, cut_every: int = 32, top: int = TOP_PAIRS, work: list[tuple[int, int]] | None = None) -> BpeTokenizer:
    """The same merges with the words left in Spark.

    A round tries the ``cut_every`` most frequent pairs one after the other, on the words that the index has for
    them, and writes what each would change. The driver goes through the changes of count in order and
    accepts merges as long as the next pair tried is really the most frequent one, at least the first. It holds
    the ``top`` most frequent pairs; when these are used up, counts and index are made anew from the
    words. ``work`` gets (merges accepted, words visited) of each round.
    """
    tokens = base_tokens()
    ids = {t: i for i, t in enumerate(tokens)}
    start = [ids[_stand_in()[b]] for b in range(256)]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def spelled(words: pa.Array) -> pa.Array:
        return pa.array([[start[b] for b in w.encode("utf-8", "surrogatepass")] for w in words.to_pylist()], pa.list_(pa.int32()))

    words = store(counts.select(spelled("word").alias("ids"), "n", F.monotonically_increasing_id().alias("word")), "bpe-words")
    index = PairIndex(words, {}, top)
    merges: list[tuple[str, str]] = []
    least = max(1, min_frequency)
    while len(tokens) < vocab_size:
        ahead = [(n, pair) for n, pair in index.pairs.first(cut_every) if n >= least]
        if not ahead:
            if index.pairs.floor < least:
                break
            index = PairIndex(words, index.ranks, top)
            if not index.pairs.first(1) and index.pairs.floor >= least:  # more pairs of one count than are held
                top *= 2
            continue
        pairs, news, named = [pair for _, pair in ahead], [], {}
        for a, b in pairs:
            joined = tokens[a] + tokens[b]
            news.append(ids.get(joined, named.get(joined, len(tokens) + len(named))))
            if joined not in ids:
                named.setdefault(joined, news[-1])
        table = index.tried(pairs, news)
        if work is not None:
            visited = table.select("step", "word").distinct().count()
        changes: dict[int, list[tuple[Pair, int]]] = {}
        for r in table.groupBy("step", "a", "b").agg(F.sum("change").alias("change")).collect():
            changes.setdefault(r["step"], []).append(((r["a"], r["b"]), r["change"]))
        done, again = 0, False
        for step, (pair, new) in enumerate(zip(pairs, news, strict=True)):
            best = index.pairs.first(1)
            if again or len(tokens) >= vocab_size or not best or best[0][1] != pair or best[0][0] < least:
                break
            a, b = pair
            merges.append((tokens[a], tokens[b]))
            made = new == len(tokens)
            if made:
                ids[tokens[a] + tokens[b]] = new
                tokens.append(tokens[a] + tokens[b])
            index.accept(pair, new, table, step)
            index.pairs.drop(pair)
            for other, by in changes.get(step, []):
                if other != pair and (other in index.pairs.counts or new in other):
                    index.pairs.change(other, by)
            # a token that was there before may be in pairs whose counts are not held
            again = not made and index.pairs.floor > 0
            done += 1
        if again:
            index = PairIndex(words, index.ranks, top)
        if work is not None:
            work.append((done, visited))
    return BpeTokenizer(tokens, merges)
