"""Byte-level BPE encoding and decoding (operator 8).

A text is split by the tokenizer's pattern; each match is encoded on its own. Bytes are
mapped to Latin-1 characters, so that a byte string is a Python string and an Aho-Corasick
automaton over the vocabulary finds every token that starts at every byte in one pass. The
encoding is then found by backtracking: take the longest token at the current byte that is
compatible with the token before it, and where none is, close that byte and retry the
previous token's next shorter choice. A byte is closed at most once, so the work is linear
in the bytes. Two tokens are compatible if merging their joint bytes from scratch by rank
gives the two again; that test is memoised per pair. Every prefix of a BPE encoding is
itself the encoding of its bytes, so the result equals that of applying the merges in rank
order.

Edge cases: a null or empty text has no tokens; its ids are the empty string and it decodes
to no bytes. Rows with null keys and repeated rows are encoded like others; there are no ties, as ranks
differ. A very long text is encoded whole; a very long match (a line of one letter) costs time in
proportion to its bytes times the longest token. An empty table gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

from pyspark.sql import DataFrame

from lexispark.llm.common import WORKER_CACHE, map_rows

#: Distinct matches whose encodings a Python worker remembers, and token pairs.
CACHE_ENTRIES = 800_000
#: Longer matches are encoded but not remembered.
CACHE_LENGTH = 64


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 of the token's bytes and its id by line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class _Known(dict):
    """Encodings of matches seen so far; others are encoded on the way."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = self.encode(match)
        if len(match) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[match] = ids
        return ids


class ByteBpe:
    """Encoder and decoder over a rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.token_bytes = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, (rank, len(token)))
        self.automaton.make_automaton()
        self.findall = regex.compile(pattern).findall
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known = _Known(self.encode_match)

    def merge_by_rank(self, text: str) -> list[int]:
        """The plain definition: merge the adjacent pair of lowest rank, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            joint = (self.token_bytes[left] + self.token_bytes[right]).decode("latin-1")
            known = self.merge_by_rank(joint) == [left, right]
            if len(self.compatible) >= CACHE_ENTRIES:
                self.compatible.clear()
            self.compatible[left, right] = known
        return known

    def encode_match(self, match: str) -> tuple[int, ...]:
        text = match.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ranks.get(text)
        if whole is not None:
            return (whole,)
        n, length, fits, compatible = len(text), self.length, self.fits, self.compatible
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for end, (rank, size) in self.automaton.iter(text):
            starting[end - size + 1].append(rank)  # ends grow, so each list grows in length
        closed = bytearray(n + 1)
        tokens: list[int] = []
        choices: list[int] = []  # index of the token taken at each boundary before this one
        at, last, k = 0, -1, len(starting[0]) - 1
        while at < n:
            here = starting[at]
            while k >= 0:
                rank = here[k]
                if not closed[at + length[rank]]:
                    if last < 0:
                        break
                    known = compatible.get((last, rank))
                    if known if known is not None else fits(last, rank):
                        break
                k -= 1
            if k >= 0:
                tokens.append(rank)
                choices.append(k)
                last = rank
                at += length[rank]
                k = len(starting[at]) - 1
            else:
                closed[at] = 1
                at -= length[tokens.pop()]
                last = tokens[-1] if tokens else -1
                k = choices.pop() - 1
        return tuple(tokens)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.findall(text or ""))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


def encoder(data: bytes, pattern: str) -> ByteBpe:
    """The encoder of a rank file; a worker process builds it once."""
    key = ("byte_bpe", hashlib.sha256(data).hexdigest(), pattern)
    if key not in WORKER_CACHE:
        WORKER_CACHE[key] = ByteBpe(parse_ranks(data), pattern)
    return WORKER_CACHE[key]


def read_vocabulary(path: str) -> bytes:
    """A tokenizer's file, read where the driver runs; its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Token ids of every text: (key, ids array<int>), or with ``digest`` their hashes.

    With ``digest`` the rows are (key, n_tokens, ids_sha256, decoded_sha256): the ids are
    decoded again and both are hashed in the worker, so that no array leaves it. A narrow
    map: no shuffle, and only the rank file (a fixed size) is broadcast.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(ranks_path))
    schema = f"{key} {dict(docs.dtypes)[key]}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")

    def make():
        bpe = encoder(data.value, pattern)
        shown = {rank: str(rank) for rank in bpe.token_bytes}

        def step(rows):
            coded = map(bpe.encode, rows[text])
            if not digest:
                return {key: rows[key], "ids": list(coded)}
            out = {key: rows[key], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in coded:
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return out

        return step

    return map_rows(docs.select(key, text), schema, make)


def decode_ids(coded: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Bytes of id lists: (key, decoded binary); null or empty lists give no bytes."""
    data = coded.sparkSession.sparkContext.broadcast(read_vocabulary(ranks_path))

    def make():
        bpe = encoder(data.value, pattern)
        return lambda rows: {key: rows[key], "decoded": [bpe.decode(x or []) for x in rows[ids]]}

    return map_rows(coded.select(key, ids), f"{key} {dict(coded.dtypes)[key]}, decoded binary", make)
