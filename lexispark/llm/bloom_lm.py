"""Language-model scoring over a log-frequency Bloom filter (operator 1).

The model is a word bigram model. Counts of bigrams are quantised to levels of about half an
octave and held in a Bloom filter: a bigram of level q is entered q times, as (bigram, 1) to
(bigram, q). A count is read back by probing levels upwards until one is missing, so a false
positive overstates a count by one level with the filter's error rate, and by more with powers
of it. Two facts keep errors down: a bigram is only probed if both its words were seen, and its
count cannot exceed either word's. Probabilities are smoothed towards the unigram:

    P(w | h) = (count(h w) + MU * P1(w)) / (count(h) + MU),   P1(w) = (count(w) + 1) / (N + V + 1)

with the exact word counts, and the number of texts for the start of a text.

Plan. Documents are read once into chunks of at most ``CHUNK_BYTES``: a chunk's distinct words
(one row each) and its texts as numbers of those words. Word counts are summed with a map-side
combine and joined back, so each chunk gets the global counts of its own words only and a word
that every chunk has is a key that the join can split; the vocabulary is never gathered. Bigrams are
counted per slice of a chunk as 64-bit hashes and dealt out by hash to segments as sorted,
difference-coded arrays. Each segment merges them, enters every training bigram into its own
bits, probes the bits for all bigrams it was sent, and sends each slice the levels back. The
number of segments follows the training tokens and no count is left out, so the filter's
quality is the same at any size of corpus; no part of it is gathered or broadcast.

Edge cases: null and empty texts are the end token alone; the learning fold may be empty (all
counts 0); null keys take part (their fold is that of the empty text); repeated rows are
learned and scored one by one; very long texts are one chunk of their own; words of equal count
keep the order in which a chunk has them; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import _arrow_schema, bound_batches, collector_off, fold, materialize, worker_task

#: Text bytes of a chunk; training tokens whose bigrams make a segment of the filter; tokens
#: whose bigrams are counted at a time.
CHUNK_BYTES = 16 << 20
SEGMENT_TOKENS = 800_000
SLICE_TOKENS = 1_200_000
#: Bits of the filter per training token, least bits per entry, probes per entry.
BITS_PER_TOKEN = 14
BITS_PER_ENTRY = 8
PROBES = 4
MU = 8.0
END = ""  # the end of a text as a token; no word is empty
HASH_BYTES = 6  # of a word's hash, kept per chunk

#: Least count of each level: 1, 2, 3, then 4, 6, 8, 12, 16, 24, ...
LEVELS = np.array([1, 2, 3] + [x for e in range(2, 40) for x in (1 << e, 3 << (e - 1))], dtype=np.int64)
#: Count that a level stands for: the middle of its range.
ESTIMATES = (LEVELS + np.r_[LEVELS[1:] - 1, LEVELS[-1]]) / 2.0

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))


def bigram_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(left + _M3) + right)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    mask = (1 << 8 * HASH_BYTES) - 1
    return np.fromiter((xxh64_intdigest(w, 7) & mask for w in words), np.uint64, len(words))


START_HASH = np.uint64((1 << 8 * HASH_BYTES) + 1)  # of the start of a text: no word has it


# --- reading documents into chunks -------------------------------------------------------


def pack_numbers(x: np.ndarray) -> bytes:
    """uint32 numbers, a plane for each of their bytes, lightly compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def tokens_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case: bytes between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Chunk:
    def __init__(self):
        self.words: dict[bytes, int] = {END.encode(): 0}
        self.numbers: list[np.ndarray] = []
        self.ids, self.held, self.bytes = [], [], 0

    def add(self, doc_id, held, text):
        own, words = tokens_of(text), self.words
        for w in own:
            if w not in words:
                words[w] = len(words)
        row = np.empty(len(own) + 1, dtype=np.uint32)
        row[:-1] = np.fromiter(map(words.__getitem__, own), np.uint32, len(own))
        row[-1] = 0
        self.numbers.append(row)
        self.ids.append(doc_id)
        self.held.append(held)
        self.bytes += len(text or "")

    def ranked(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words by falling frequency (the end stays first), the tokens as their numbers, which
        are then mostly small, and the words' training counts."""
        numbers = np.concatenate(self.numbers)
        order = np.argsort(-np.bincount(numbers, minlength=len(self.words))[1:], kind="stable") + 1
        order = np.r_[0, order].astype(np.int64)
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        numbers = place[numbers]
        learn = np.repeat(~np.asarray(self.held, bool), list(map(len, self.numbers)))
        words = list(self.words)
        return [words[i] for i in order.tolist()], numbers, np.bincount(numbers[learn], minlength=len(words))


def _chunks(batches, key: str):
    """(chunk number, chunk) of a task's rows, in order."""
    base, serial, chunk = TaskContext.get().partitionId() << 24, 0, _Chunk()
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in (key, "held_out", "text")]
        for at in range(0, batch.num_rows, 64):
            with collector_off():
                for doc_id, held, text in zip(*(c.slice(at, 64).to_pylist() for c in columns), strict=True):
                    chunk.add(doc_id, held, text)
            if chunk.bytes >= CHUNK_BYTES:
                done, chunk = chunk, None
                yield base | serial, done
                del done
                serial, chunk = serial + 1, _Chunk()
    if chunk.ids:
        yield base | serial, chunk


WORDS, TEXTS = 0, 1  # kinds of rows
_CHUNK_SCHEMA = "kind int, chunk bigint, number int, word binary, n bigint, ids array<bigint>, held array<boolean>, lengths array<int>, numbers binary, hashes binary"


def read_chunks(docs: DataFrame, key: str) -> DataFrame:
    """Rows of kind WORDS (chunk, number, word, n: training count) and TEXTS (a chunk's texts)."""
    from pyspark.sql import types as T

    struct = T._parse_datatype_string(_CHUNK_SCHEMA)
    arrow = _arrow_schema(struct)

    def rows(size: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def run(batches):
        with worker_task("read_chunks"):
            yield from of_chunks(batches)

    def of_chunks(batches):
        for number, chunk in _chunks(batches, key):
            words, numbers, counts = chunk.ranked()
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                own = np.arange(at, at + len(part), dtype=np.int32)
                yield rows(len(part), kind=np.full(len(part), WORDS, np.int32), chunk=np.full(len(part), number), number=own, word=part, n=counts[own])
            hashes = word_hashes(words).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
            yield rows(1, kind=[TEXTS], chunk=[number], ids=[chunk.ids], held=[chunk.held], lengths=[list(map(len, chunk.numbers))], numbers=[pack_numbers(numbers)], hashes=[hashes])
            del chunk, words, numbers, counts, hashes  # before the next chunk fills up

    return docs.mapInArrow(run, struct)


# --- bigrams -> filter -------------------------------------------------------------------


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted uint32 numbers by their differences."""
    return pack_numbers(np.diff(x.astype(np.int64), prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data))


def _bigrams_of(numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it in its text; numbers end texts with 0."""
    own = hashes[numbers]
    left = np.empty_like(own)
    left[1:] = own[:-1]
    left[np.r_[True, numbers[:-1] == 0]] = START_HASH
    return bigram_hash(left, own)


def text_slices(lengths: np.ndarray):
    """(first text, text after the last) of each slice of a chunk: whole texts, about
    ``SLICE_TOKENS`` tokens, so that memory does not follow the chunk."""
    piece = (np.cumsum(lengths) - 1) // SLICE_TOKENS
    bounds = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    return zip(bounds.tolist(), [*bounds[1:].tolist(), len(lengths)], strict=True)


def placed(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segment and lower half of a hash as one number: the identity of a bigram in the filter."""
    return segment_of(keys, segments) << 32 | (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def count_bigrams(texts: DataFrame, segments: int) -> DataFrame:
    """(segment, chunk, slice, keys, counts): a slice's distinct bigrams of all texts in a
    segment, in order, and how often training texts have them. Segments that a slice has no bigram
    in are not touched, so rows and work never exceed the bigrams, however many segments there are."""
    schema = pa.schema([("segment", pa.int32()), ("chunk", pa.int64()), ("slice", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def count(chunk: int, at: int, numbers: np.ndarray, learn: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        places = placed(_bigrams_of(numbers, hashes), segments)
        order = np.argsort(places)
        places = places[order]
        first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        counts = np.add.reduceat(learn[order].astype(np.int64), first)
        places = places[first]
        met, starts = np.unique(places >> 32, return_index=True)
        out: dict[str, list] = {name: [] for name in schema.names}
        for s, a, b in zip(met.tolist(), starts, [*starts[1:], len(places)], strict=True):
            out["segment"].append(s)
            out["chunk"].append(chunk)
            out["slice"].append(at)
            out["keys"].append(pack_sorted(places[a:b] & 0xFFFFFFFF))
            out["counts"].append(pack_numbers(counts[a:b]))
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches):
        with worker_task("count_bigrams"):
            yield from of_rows(batches)

    def of_rows(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pydict()
                numbers, hashes = unpack_numbers(row["numbers"][0]), unpack_hashes(row["hashes"][0])
                lengths, learn = np.asarray(row["lengths"][0], np.int64), ~np.asarray(row["held"][0], bool)
                ends = np.cumsum(lengths)
                for i, (first, last) in enumerate(text_slices(lengths)):
                    span = numbers[ends[first] - lengths[first] : ends[last - 1]]
                    yield count(row["chunk"][0], i, span, np.repeat(learn[first:last], lengths[first:last]), hashes)

    return texts.select("chunk", "lengths", "held", "numbers", "hashes").mapInArrow(run, "segment int, chunk bigint, slice int, keys binary, counts binary")


def unpack_hashes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), dtype=np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segments share the range of the hashes' upper halves evenly."""
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _probes(short: np.ndarray, level: int, bits: int):
    """Bit places of (key, level), one array per probe."""
    base = _mix(short * _M3 + np.uint64(level))
    step = (base << np.uint64(32)) | (base >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for _ in range(PROBES):
            yield ((base >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
            base = base + step


def enter(short: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """A segment's bits with all levels of all bigrams entered."""
    level = np.searchsorted(LEVELS, counts, side="right")  # 1 is the first
    field = np.zeros(-(-bits // 8) * 8, dtype=np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        for place in _probes(short[level >= q].astype(np.uint64), q, bits):
            field[place] = 1
    return np.packbits(field, bitorder="little")


class LogBloom:
    """Segments of equal size, found by the hash's upper half; probed by its lower half."""

    def __init__(self, data: np.ndarray, segments: int, bits: int):
        self.data, self.segments, self.bits = data, segments, bits

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Highest level up to which every level of a key is present; 0: never seen."""
        found = np.zeros(len(keys), dtype=np.int64)
        offset = segment_of(keys, self.segments) * (-(-self.bits // 8))
        short = keys & np.uint64(0xFFFFFFFF)
        alive = np.arange(len(keys))
        for q in range(1, len(LEVELS) + 1):
            if not len(alive):
                break
            sure = np.ones(len(alive), dtype=bool)
            for i, place in enumerate(_probes(short[alive], q, self.bits)):
                if i == 0:
                    sure = (self.data[offset[alive] + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    continue
                rest = np.flatnonzero(sure)
                p = place[rest]
                sure[rest] = (self.data[offset[alive[rest]] + (p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1) == 1
            alive = alive[sure]
            found[alive] = q
        return found


def segment_levels(short: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Levels that a segment's filter gives the distinct bigrams ``short``; those with a count
    are entered, all of them: the segment has ``bits`` or as many more as its entries need."""
    seen = counts > 0
    entries = int(np.searchsorted(LEVELS, counts[seen], side="right").sum())
    bits = max(bits, -(-BITS_PER_ENTRY * entries // 8) * 8)
    return LogBloom(enter(short[seen], counts[seen], bits), 1, bits).levels(short.astype(np.uint64))


def segments_for(train_tokens: int) -> int:
    return max(1, -(-train_tokens // SEGMENT_TOKENS))


def probe_bigrams(texts: DataFrame, train_tokens: int) -> DataFrame:
    """(chunk, slice, segment, levels): the filter's levels of each slice's distinct bigrams."""
    segments = segments_for(train_tokens)
    bits = max(64, max(1024, BITS_PER_TOKEN * train_tokens) // segments // 8 * 8)

    def probe(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        short = np.concatenate(keys)
        counts = np.concatenate([unpack_numbers(c) for c in table["counts"].to_pylist()])
        order = np.argsort(short)
        short, counts = short[order], counts[order]
        new = np.r_[True, short[1:] != short[:-1]]
        first = np.flatnonzero(new)
        found = segment_levels(short[first], np.add.reduceat(counts, first), bits)
        levels = np.empty(len(short), dtype=np.uint8)
        levels[order] = found[np.cumsum(new) - 1]
        packed = [zlib.compress(part.tobytes(), 1) for part in np.split(levels, ends[:-1])]
        return pa.table({"chunk": table["chunk"], "slice": table["slice"], "segment": table["segment"], "levels": pa.array(packed, pa.binary())})

    return count_bigrams(texts, segments).groupBy("segment").applyInArrow(probe, "chunk bigint, slice int, segment int, levels binary")


# --- scoring -----------------------------------------------------------------------------


def slice_levels(numbers: np.ndarray, hashes: np.ndarray, segments: int, parts: dict[int, bytes]) -> np.ndarray:
    """The level of every token's bigram in a slice, from the levels that each segment sent."""
    distinct, own = np.unique(placed(_bigrams_of(numbers, hashes), segments), return_inverse=True)
    levels = np.frombuffer(b"".join(zlib.decompress(parts[s]) for s in np.unique(distinct >> 32).tolist()), np.uint8)
    return levels[own]


def score_chunk(numbers: np.ndarray, lengths: np.ndarray, levels: np.ndarray, counts: np.ndarray, n: int, v: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_known, base, score) of whole texts of a chunk, from the global counts of its words and the
    levels of its bigrams; a bigram of a word never seen has none."""
    p1 = (counts + 1.0) / (n + v + 1.0)
    base, known, log_p = np.empty(len(numbers)), np.empty(len(numbers), np.int64), np.empty(len(numbers))
    for at in range(0, len(numbers), 500_000):
        part = slice(at, at + 500_000)
        own = numbers[part]
        before = np.r_[numbers[at - 1] if at else 0, own[:-1]]
        c_left = np.where(before == 0, texts, counts[before])  # 0 ends the text before
        c_right = counts[own]
        pair = np.minimum(np.r_[0.0, ESTIMATES][levels[part]], np.minimum(c_left, c_right))
        base[part], known[part] = np.log10(p1[own]), c_right > 0
        log_p[part] = np.log10((pair + MU * p1[own]) / (c_left + MU))
    first = np.cumsum(lengths) - lengths
    return np.add.reduceat(known, first), np.add.reduceat(base, first), np.add.reduceat(log_p, first)


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), (fold(key, folds) == held_out).alias("held_out"), F.col(text).alias("text"))
    chunks = materialize_by_kind(read_chunks(source, "doc_id"))
    words, texts = chunks(WORDS), chunks(TEXTS)

    totals = materialize(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "word-counts")
    sums = totals.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.octet_length("word") == 0, F.col("c"))).alias("texts")).first()
    n, v, n_texts = int(sums["n"] or 0), int(sums["v"]), int(sums["texts"] or 0)
    counted = words.select("chunk", "number", "word").join(totals, "word")  # words without a count are left at 0
    segments = segments_for(n)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        is_text = left["levels"].is_null()
        row = left.filter(is_text).to_pydict()
        counts = np.zeros(len(row["hashes"][0]) // HASH_BYTES, dtype=np.int64)
        counts[right["number"].to_numpy()] = right["c"].to_numpy()
        lengths, numbers = np.asarray(row["lengths"][0], dtype=np.int64), unpack_numbers(row["numbers"][0])
        rows = left.filter(pc.invert(is_text)).select(["slice", "segment", "levels"]).to_pydict()
        parts: dict[int, dict[int, bytes]] = {}
        for i, segment, data in zip(rows["slice"], rows["segment"], rows["levels"], strict=True):
            parts.setdefault(i, {})[segment] = data
        hashes, ends, sums = unpack_hashes(row["hashes"][0]), np.cumsum(lengths), []
        for i, (first, last) in enumerate(text_slices(lengths)):
            own = numbers[ends[first] - lengths[first] : ends[last - 1]]
            sums.append(score_chunk(own, lengths[first:last], slice_levels(own, hashes, segments, parts[i]), counts, n, v, n_texts))
        known, base, total = (np.concatenate(x) for x in zip(*sums, strict=True))
        return pa.table(
            {"doc_id": pa.array(row["ids"][0], pa.int64()), "held_out": pa.array(row["held"][0], pa.bool_()), "n_tokens": lengths, "n_known": known, "train_tokens": np.full(len(lengths), n), "base_score": base, "score": total}
        )

    own = texts.select("chunk", "ids", "held", "lengths", "numbers", "hashes")
    left = own.unionByName(probe_bigrams(texts, n), allowMissingColumns=True).groupBy("chunk")
    right = counted.select("chunk", "number", "c").groupBy("chunk")
    return left.cogroup(right).applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def materialize_by_kind(rows: DataFrame):
    """Write rows once, a folder per kind; returns a reader of one kind."""
    import uuid

    from lexispark.llm.common import _scratch, shared_dir

    path = "/".join([shared_dir(rows.sparkSession), "lexispark", *_scratch, f"chunks-{uuid.uuid4().hex}"])
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    schema = rows.drop("kind").schema.add("kind", "integer")

    def read(kind: int) -> DataFrame:
        return rows.sparkSession.read.schema(schema).parquet(path).where(F.col("kind") == kind).drop("kind")

    return read
