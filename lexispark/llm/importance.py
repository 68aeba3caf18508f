"""Target-distribution importance resampling (operator 11).

Documents are drawn without replacement with a probability that follows how much more their word
runs look like a target collection than like the corpus.

1. A feature is a run of 1 to ``runs`` consecutive words; its bucket is its crc32 modulo ``buckets``.
   Each task counts the features of its rows in one array, and the arrays are added up by bucket:
   ``buckets`` rows are all that comes to the driver, whatever the size of the corpus.
2. A bucket's gain is the floored logarithm of its smoothed share in the target over that in the
   corpus. The array of gains goes to the tasks, which score a text by adding up the array's entries.
3. The score adds Gumbel noise made of the row's key, so that the highest scores are a weighted
   draw without replacement and a row's noise depends on its key alone.
4. The key that ends the draw is found by radix selection on the composite key (score falling, doc_id
   rising, row number): each pass counts one digit of the rows that still match, and the digit in
   which the k-th row lies is fixed. No row is sorted or moved for it.
5. Only the rows drawn are dealt out by range of that key, sorted and numbered; a partition's
   numbers start after those of the ones before it.

A crc32 is linear in what precedes it: crc(a + b) = crc(b) ^ M(crc(a)), where M depends on b's length
alone. So distinct words are hashed once a piece and runs are combined in arrays.

Edge cases: null and empty texts have no words, hence weight 0; a null key has the noise of the text
``<seed>:`` and ranks behind equal scores with a key; repeated rows and equal (score, key) are told apart
by their row number, so exactly the asked number of rows is drawn; texts of any length are read whole,
in pieces of ``PIECE`` bytes that end between words; an empty target or corpus leaves the smoothing
alone; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import bound_batches, materialize, slices, worker_task

BUCKETS = 10_000
#: Bytes of text that are held as arrays at a time.
PIECE = 1 << 21
#: Bits of a key that one pass of the selection counts, hence 2,048 rows to the driver.
DIGIT = 11
#: Words up to this length are combined by tables, longer ones one by one.
TABLED = 64

#: Bytes of words: 0-9, a-z (A-Z lower-cased) and all of a character beyond ASCII; 0 for others.
_LETTER = np.array([c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0 for c in range(256)], dtype=np.uint8)


def _shift_tables() -> np.ndarray:
    """[length, byte number, byte]: what a byte of crc(a) becomes behind so many more bytes."""
    tables = np.zeros((TABLED + 1, 4, 256), dtype=np.uint32)
    for length in range(1, TABLED + 1):
        blank = b"\0" * length
        basis = np.array([zlib.crc32(blank, 1 << bit) ^ zlib.crc32(blank) for bit in range(32)], dtype=np.uint32)
        for byte in range(4):
            for bit in range(8):
                tables[length, byte, (np.arange(256) >> bit & 1).astype(bool)] ^= basis[8 * byte + bit]
    return tables


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Starts of all words of ``data``, the words' dictionary and each word's number in it; a word never
    crosses one of ``bounds``, the offsets at which texts begin."""
    data = _LETTER[data]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = bounds[bounds < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    ends = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(ends[starts] - 1, ends[-1] if len(ends) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return starts, coded.dictionary, coded.indices.to_numpy()


def _run_hashes(dictionary: pa.Array, ids: np.ndarray, depth: np.ndarray, runs: int, tables: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of runs: the places of the words that end one, and the runs' crc32. ``depth``
    is how many words of its text precede a word."""
    texts = dictionary.to_pylist()
    alone = np.array([zlib.crc32(w) for w in texts], dtype=np.uint32)[ids]
    places, hashes = np.arange(len(ids)), alone
    yield places, hashes
    if runs > 1:
        behind = np.array([zlib.crc32(b" " + w) for w in texts], dtype=np.uint32)
        length = np.array([len(w) + 1 for w in texts], dtype=np.int64)
    for n in range(1, runs):
        before = np.zeros(len(ids), dtype=np.uint32)
        before[places] = hashes
        places = np.flatnonzero(depth >= n)
        a, word = before[places - 1], ids[places]
        at = np.minimum(length[word], TABLED)
        hashes = behind[word] ^ tables[at, 0, a & 255] ^ tables[at, 1, a >> 8 & 255] ^ tables[at, 2, a >> 16 & 255] ^ tables[at, 3, a >> 24]
        for i in np.flatnonzero(length[word] > TABLED):
            hashes[i] = zlib.crc32(b" " + texts[word[i]], int(a[i]))
        yield places, hashes


def _pieces(data: np.ndarray, offsets: np.ndarray, runs: int, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first text, bytes, bounds, words that only lead in) in pieces of about ``limit`` bytes.

    Texts are taken whole, several a piece; one longer than ``limit`` comes in several pieces, of which
    each but the first repeats the last ``runs`` - 1 words before it.
    """
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        low, high = int(offsets[first]), int(offsets[last])
        if high - low <= limit:
            yield first, data[low:high], offsets[first:last] - low, 0
        else:
            start, end, led = low, low, 0
            while end < high:
                end = min(high, end + limit)
                while end < high and _LETTER[data[end]]:
                    end += 1
                yield first, data[start:end], np.zeros(1, dtype=np.int64), led
                start, led = _lead(data, low, end, runs - 1)
        first = last


def _lead(data: np.ndarray, low: int, end: int, words: int) -> tuple[int, int]:
    """Where the last ``words`` words before ``end`` begin, and how many there are."""
    at, found = end, 0
    while found < words:
        while at > low and not _LETTER[data[at - 1]]:
            at -= 1
        if at == low:
            break
        while at > low and _LETTER[data[at - 1]]:
            at -= 1
        found += 1
    return at, found


def _buckets_of(column: pa.Array, runs: int, buckets: int, tables: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Piece by piece: first text, number of texts, the text of each word, and (places, buckets) of
    the runs of each length; words that only lead in are left out as ends of runs."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    for first, piece, bounds, led in _pieces(data, offsets, runs, limit):
        starts, dictionary, ids = _words(piece, bounds)
        text = np.searchsorted(bounds, starts, "right") - 1
        depth = np.arange(len(starts)) - np.searchsorted(text, text)
        found = [(places[places >= led], (hashes % buckets)[places >= led]) for places, hashes in _run_hashes(dictionary, ids, depth, runs, tables)] if len(ids) else []
        yield first, len(bounds), text, found


def count_buckets(table: DataFrame, *, text: str = "text", runs: int = 2, buckets: int = BUCKETS, piece: int = PIECE) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    bound_batches(table.sparkSession)

    def run(batches):
        with worker_task("importance.count"):
            total, tables = np.zeros(buckets, dtype=np.int64), _shift_tables()
            for batch in slices(batches):
                for _, _, _, found in _buckets_of(batch.column(0), runs, buckets, tables, piece):
                    for _, at in found:
                        total += np.bincount(at, minlength=buckets)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    counted = table.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.collect():
        found[bucket] = n
    return found


def bucket_gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * log of the smoothed share in the target over that in the corpus) of each bucket."""
    size = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + size)) / ((s + 1) * (t.sum() + size))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def weigh(table: DataFrame, gains: np.ndarray, *, key: str = "doc_id", text: str = "text", runs: int = 2, piece: int = PIECE) -> DataFrame:
    """(key, n_words, n_features, total): features of each text and the sum of their gains."""
    bound_batches(table.sparkSession)
    buckets = len(gains)

    def run(batches):
        with worker_task("importance.weigh"):
            tables = _shift_tables()
            for batch in slices(batches):
                sums = np.zeros((3, batch.num_rows), dtype=np.int64)
                for first, n, of, found in _buckets_of(batch.column(1), runs, buckets, tables, piece):
                    for length, (places, at) in enumerate(found):
                        here = first + of[places]
                        if length == 0:
                            sums[0] += np.bincount(here, minlength=batch.num_rows)
                        sums[1] += np.bincount(here, minlength=batch.num_rows)
                        running = np.concatenate([[0], np.cumsum(gains[at])])
                        ends = np.searchsorted(here, np.arange(first, first + n + 1))
                        sums[2, first : first + n] += running[ends[1:]] - running[ends[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=["key", "n_words", "n_features", "total"])

    schema = T.StructType([T.StructField("key", table.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "total")]])
    return table.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def noise(key: Column, seed: int, scale: int = 1000) -> Column:
    """Floored Gumbel noise of a key: -ln(-ln u), u from the first 32 bits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def floor_mean(total: str, n: str) -> Column:
    """The whole part, downwards, of total / n in integers; 0 where n is 0."""
    return F.when(F.col(n) == 0, F.lit(0).cast("bigint")).otherwise(F.expr(f"({total} - pmod({total}, {n})) div {n}"))


_TOP = 1 << 63


def kth_key(rows: DataFrame, k: int, columns: list[str]) -> tuple | None:
    """The k-th smallest (from 1) of the composite keys ``columns`` (long, without nulls) of a stored
    table; None where it has fewer rows. Exact: a radix selection from the highest digit down."""
    here, fixed = F.lit(True), []
    for place, column in enumerate(columns):
        ordered = F.col(column).bitwiseXOR(F.lit(-_TOP))  # as an unsigned number
        low, high, n = rows.where(here).agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
        if n < k:
            return None
        if n == k:
            rest = rows.where(here).agg(F.max(F.struct(*columns[place:]))).first()[0]
            return (*fixed, *rest)
        low, high = low + _TOP, high + _TOP
        bits = (low ^ high).bit_length()
        prefix = low >> bits
        while bits:
            width = min(DIGIT, bits)
            shift = bits - width
            matches = here if bits == 64 else here & (F.shiftrightunsigned(ordered, bits) == prefix)
            digit = F.shiftrightunsigned(ordered, shift).bitwiseAND((1 << width) - 1)
            counts = sorted(map(tuple, rows.where(matches).groupBy(digit.alias("digit")).count().collect()))
            for value, n in counts:
                if k <= n:
                    break
                k -= n
            prefix, bits = prefix << width | value, shift
        fixed.append(prefix - _TOP)
        here = here & (F.col(column) == fixed[-1])
    return tuple(fixed)


def numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3 ... by ``columns``: dealt by range, sorted and numbered in each
    partition, then moved up by what the partitions before hold (one count a partition)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])

    def run(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            extra = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(done + 1, done + n + 1, dtype=np.int64))]
            done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[f.name for f in schema])

    stored = materialize(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).mapInArrow(run, schema), "importance-drawn")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, stored.groupBy("part").count().collect())):
        offsets.append((part, before))
        before += n
    shift = rows.sparkSession.createDataFrame(offsets, "part int, before bigint")
    return stored.join(F.broadcast(shift), "part").select(*rows.columns, (F.col("rank") + F.col("before")).alias("rank"))


#: The composite key of the draw, of long columns without nulls.
ORDER = ["falling", "unkeyed", "at", "row"]


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 25, min_words: int = 20, runs: int = 2, buckets: int = BUCKETS, seed: int = 7, key: str = "doc_id", text: str = "text", piece: int = PIECE
) -> DataFrame:
    """Per row of ``docs``: key, n_features, weight, score and rank (null where not drawn).

    Of the N rows with at least ``min_words`` words floor(percent * N / 100) are drawn. ``key`` is a
    whole number.
    """
    shape = {"text": text, "runs": runs, "buckets": buckets, "piece": piece}
    gains = bucket_gains(count_buckets(docs, **shape), count_buckets(target, **shape))
    weight = floor_mean("total", "n_features")
    weighed = weigh(docs, gains, key=key, text=text, runs=runs, piece=piece).select("key", "n_words", "n_features", weight.alias("weight"))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    keys = {"falling": F.bitwise_not("score"), "unkeyed": F.col("key").isNull().cast("bigint"), "at": F.coalesce(F.col("key").cast("bigint"), F.lit(0)), "row": F.monotonically_increasing_id()}
    stored = materialize(scored.withColumns(keys), "importance-scored")
    able = F.col("n_words") >= min_words
    k = percent * stored.where(able).count() // 100
    last = kth_key(stored.where(able), k, ORDER) if k else None
    drawn = able & (F.struct(*ORDER) <= F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(ORDER, last, strict=True)])) if last else F.lit(False)
    shown = [F.col("key").alias(key), "n_features", "weight", "score"]
    rest = stored.where(~drawn).select(*shown, F.lit(None).cast("bigint").alias("rank"))
    return numbered(stored.where(drawn), ORDER).select(*shown, "rank").unionByName(rest) if last else rest
