"""SimHash near-duplicates through a byte-position index with count filtering (operator 3).

A fingerprint's 8 bytes are its positional features. Fingerprints that differ in at most r
bits differ in at most r bytes, so they share at least m = 8 - r positional bytes: the
guaranteed minimum of the count filter. The index's posting lists are kept per choice of m
positions and the values there (56 choices of 5 bytes for r = 3). Two fingerprints meet in a
list if and only if their tally reaches m, so pairs whose tally is too low are never formed,
and a list is a 40-bit key: at a billion fingerprints almost every list has one member. In a
list the tally is checked together with the bit distance (verification).

A list can only hold 2**(8 * r) different fingerprints, as all else is fixed; inside it the
links are followed breadth first against the members not reached yet, so that a large group
of near copies costs its edges to a spanning forest, not its pairs. The forests' edges are
joined into components by ``components``. Documents of equal fingerprint are one node.

At 3 bits only texts with few edits are near. ``similar_documents`` joins all pairs of a Jaccard
similarity of 0.8 or more of their 5-word shingles, whose 64-bit fingerprints differ in some ten bits,
more than any byte index over them can promise to find. It goes two ways: most links, those
of groups of copies above all, are found by sampled positions, and an exact filter then finds every
link that these have left out.

For the samples a document has ``SKETCHES`` positions; at
each the value is the SimHash of the ``SAMPLE`` shingles that a hash function of that position ranks
lowest. Two documents have a value in common with probability J**SAMPLE at each position, so a pair at
0.8 shares none of 12 with probability 0.0003. A posting list (position, value) yields its
members' nearest pairs by the distance of 128-bit fingerprints over all shingles: a forest of least
distances and some nearest members of each, never all pairs; lists of more than ``LIST_MEMBERS`` are
dealt into parts by chance, differently at each position. A pair must pass the ratio of sizes and
a bound on the distance (at five standard deviations), and is then verified by the Jaccard
similarity of the sets of 32-bit shingle hashes.

For the exact filter the shingles of all texts have one order, rare ones first (``shingle_counts``). Let two texts of
n >= m different shingles have the similarity t, and their first common shingle in that order be
at places i and j. All that they share comes from there on, so min(n - i, m - j) is at least
t / (1 + t) of n + m. Hence i < (1 - t) n + 1, and the smaller text's j is below (1 - 2t / (1 + t)) m + 1: a text
posts no more than its first fifth, and as the smaller one of a pair no more than its first ninth. Texts
that share a template of 89 % or less post none of it as smaller ones, so long lists lead to
few pairs. Pairs come from an equi-join on the shingle under this condition, only for texts that the first
way has not joined already, and all of them are verified; nothing is cut.

Edge cases: null and empty texts and texts of white space have fingerprint zero and are linked
like any other (in ``similar_documents``: to each other); a text of fewer words than a shingle is one
shingle; very long texts are read whole; null keys are rows like others but never name a component
unless all of it is null; repeated rows share a component; an empty table gives no rows; other
columns, whatever their names, are ignored, and carried by ``keep_first``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import bound_batches, collector_off, fresh, join_hot, map_rows, materialize, slices, worker_task
from lexispark.llm.components import connected_components
from lexispark.model.gradients import sliced, tree_sum

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BYTES = 8
#: Of ``similar_documents``: words of a shingle, least Jaccard similarity, positions, shingles of a
#: position's sample, bits of the fingerprint over all shingles, members of a list that are held
#: together, and nearest members that each is compared with besides the forest's.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
SKETCHES = 12
SAMPLE = 3
FULL_BITS = 128
LIST_MEMBERS = 4096
NEIGHBOURS = 12
#: Above so many members a list's links are found by trying all masks of up to r bits.
ENUMERATE_ABOVE = 60_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Unsigned 64-bit hashes of a text's word shingles, repeats included; none without words."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(tokens)
    if len(tokens) < words:
        return np.array([xxh64_intdigest(joined, SEED)], dtype="<u8")
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    return majority(shingle_hashes(text, words))


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, fp bigint): the fingerprint's 64 bits as a signed number."""
    kinds = dict(docs.dtypes)

    def make():
        return lambda rows: {c: rows[c] for c in (key, *carry)} | {"fp": [signed(fingerprint(t, words)) for t in rows[text]]}

    return map_rows(docs.select(key, *carry, text), ", ".join(f"{c} {kinds[c]}" for c in (key, *carry)) + ", fp bigint", make)


def position_masks(max_bits: int = MAX_BITS) -> list[int]:
    """A mask for each choice of the guaranteed minimum number of byte positions."""
    return [signed(sum(0xFF << (8 * i) for i in chosen)) for chosen in combinations(range(BYTES), BYTES - max_bits)]


def forest(members: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges (member, root) that span the links among distinct fingerprints of one list."""
    edges: list[tuple[int, int]] = []
    rest = np.unique(members)
    if len(rest) > ENUMERATE_ABOVE:
        return _forest_by_masks(rest, max_bits)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = np.array([root])
        while len(frontier) and len(rest):
            step, frontier = frontier[:64], frontier[64:]
            apart = step[:, None] ^ rest[None, :]
            # count filter, then verification; in a list of the index every tally reaches the minimum
            shared = (apart.view(np.uint8).reshape(*apart.shape, BYTES) == 0).sum(axis=2)
            near = ((shared >= BYTES - max_bits) & (np.bitwise_count(apart.view(np.uint64)) <= max_bits)).any(axis=0)
            found, rest = rest[near], rest[~near]
            edges += [(int(x), int(root)) for x in found]
            frontier = np.concatenate([frontier, found])
    return edges


def _forest_by_masks(rest: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """The same for very long lists: linear in members times masks of up to r bits."""
    varying = int(np.bitwise_or.reduce(rest ^ rest[0]).view(np.uint64))
    bits = [1 << i for i in range(64) if varying >> i & 1]
    masks = np.array([signed(sum(c)) for n in range(1, max_bits + 1) for c in combinations(bits, n)], dtype=np.int64)
    reached = np.zeros(len(rest), dtype=bool)
    edges: list[tuple[int, int]] = []
    for first in range(len(rest)):
        if reached[first]:
            continue
        reached[first] = True
        frontier = np.array([first])
        while len(frontier):
            step, frontier = frontier[:256], frontier[256:]
            wanted = (rest[step][:, None] ^ masks[None, :]).ravel()
            at = np.minimum(np.searchsorted(rest, wanted), len(rest) - 1)
            at = np.unique(at[rest[at] == wanted])
            at = at[~reached[at]]
            reached[at] = True
            edges += [(int(x), int(rest[first])) for x in rest[at]]
            frontier = np.concatenate([frontier, at])
    return edges


def link_edges(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): edges whose components are those of all links between distinct ``fp``."""
    masks = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), F.lit(m).cast("bigint").alias("mask")) for i, m in enumerate(position_masks(max_bits))])
    # A table of a few bytes a document becomes 56 postings each: deal it out for that first.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    postings = distinct.select("fp").repartition(tasks).select("fp", F.explode(masks).alias("p")).select("fp", F.col("p.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("p.mask")).alias("value"))
    # Nearly all lists have one member, so nothing is gained by combining them before the shuffle.
    lists = postings.repartition("choice", "value").groupBy("choice", "value").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")

    def make():
        def step(rows):
            edges = {edge for members in rows["members"] for edge in forest(np.array(members, dtype=np.int64), max_bits)}
            return {"a": [a for a, _ in edges], "b": [b for _, b in edges]}

        return step

    return map_rows(lists, "a bigint, b bigint", make)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, fingerprint (hex) and component_id, the smallest key that links reach."""
    prints = materialize(fingerprints(docs, key=key, text=text, words=words, carry=carry), "fingerprints")
    named = name_components(prints, lambda distinct: link_edges(distinct, max_bits), key)
    return named.select(key, *carry, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def name_components(prints: DataFrame, edges_of: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """``prints`` with component_id: the smallest key among rows whose ``fp`` the edges join."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    roots = connected_components(edges_of(distinct))
    linked = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "first")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    named = linked.join(lowest, "root").select("fp", "lowest")
    ids = distinct.join(named, "fp", "left").select("fp", "rows", F.coalesce("lowest", "first").alias("component_id"))
    return join_hot(prints, materialize(ids, "component-names"), ["fp"], "rows").drop("rows")


# --- pairs of a Jaccard similarity -------------------------------------------------------

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MUL1
        x = (x ^ (x >> np.uint64(27))) * _MUL2
        return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64))


def sketches(distinct: np.ndarray) -> list[int]:
    """Per position the SimHash of the SAMPLE distinct hashes that the position ranks lowest."""
    out = []
    for seed in _SEEDS:
        ranked = _mixed(distinct ^ seed)
        if len(distinct) > SAMPLE:
            chosen = np.argpartition(ranked, SAMPLE - 1)[:SAMPLE]
            ranked = ranked[chosen]
        out.append(signed(majority(_mixed(ranked + seed))))
    return out


def signatures(docs: DataFrame, *, key: str, text: str, words: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, fp: identity of the text's words, n: distinct shingles, f0 and f1: the
    128-bit fingerprint, values: the positions' values, hashes: the shingles' 32-bit hashes)."""
    kinds = dict(docs.dtypes)

    def make():
        from xxhash import xxh64_intdigest

        def step(rows):
            out: dict[str, list] = {c: rows[c] for c in (key, *carry)} | {c: [] for c in ("fp", "n", "f0", "f1", "values", "hashes")}
            for value in rows[text]:
                tokens = (value or "").encode("utf-8", "surrogatepass").lower().split()
                distinct = np.unique(shingle_hashes(value, words))
                out["fp"].append(signed(xxh64_intdigest(b" ".join(tokens), 1)))
                out["n"].append(len(distinct))
                out["f0"].append(signed(majority(distinct)))
                out["f1"].append(signed(majority(_mixed(distinct))))
                out["values"].append(sketches(distinct) if len(distinct) else [])
                out["hashes"].append(np.unique(distinct & np.uint64(0xFFFFFFFF)).astype("<u4").view("<i4"))
            return out

        return step

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry)) + ", fp bigint, n int, f0 bigint, f1 bigint, values array<bigint>, hashes array<int>"
    return map_rows(docs.select(key, *carry, text), schema, make)


def bit_limit(similarity: float) -> int:
    """Differing bits of FULL_BITS that pairs of a Jaccard similarity stay below, at five standard
    deviations: their sets' cosine is 2 J / (1 + J) at least."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(FULL_BITS * share + 5 * math.sqrt(FULL_BITS * share * (1 - share)))


def nearest_pairs(fp: np.ndarray, n: np.ndarray, full: np.ndarray, similarity: float) -> set[tuple[int, int]]:
    """Pairs of a list's members (distinct ``fp``; ``full``: their fingerprints [members, 2]) worth
    verifying: a spanning forest of least distances, and each member's NEIGHBOURS nearest, as far
    as distance and sizes allow a link. Memory follows the members, not their pairs."""
    limit, never = bit_limit(similarity), FULL_BITS + 1
    out: set[tuple[int, int]] = set()

    def add(i: int, j: int) -> None:
        out.add((max(int(fp[i]), int(fp[j])), min(int(fp[i]), int(fp[j]))))

    free = np.ones(len(fp), dtype=bool)
    best, source, now = np.full(len(fp), never), np.zeros(len(fp), dtype=np.int64), 0
    while True:
        free[now] = False
        apart = np.bitwise_count((full ^ full[now]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        apart[np.minimum(n, n[now]) < similarity * np.maximum(n, n[now])] = never
        apart[now] = never
        near = np.argpartition(apart, NEIGHBOURS)[:NEIGHBOURS] if len(fp) > NEIGHBOURS + 1 else np.arange(len(fp))
        for j in near[apart[near] <= limit].tolist():
            add(now, j)
        closer = free & (apart < best)
        best[closer], source[closer] = apart[closer], now
        left = np.flatnonzero(free)
        if not len(left):
            return out
        now = int(left[best[left].argmin()])
        if best[now] <= limit:
            add(now, int(source[now]))


def similar_edges(signed_: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified pairs of different ``fp``."""
    tasks = int(signed_.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    first = lambda *columns: [F.first(c).alias(c) for c in columns]
    distinct = materialize(signed_.groupBy("fp").agg(*first("n", "f0", "f1", "values")).repartition(tasks), "distinct-signatures")
    postings = distinct.select("fp", "n", "f0", "f1", F.posexplode("values").alias("position", "value"))
    sizes = postings.groupBy("position", "value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = join_hot(postings, materialize(sizes, "list-sizes"), ["position", "value"], "members")
    # a long list is dealt into parts by chance, another way at each position
    part = F.pmod(F.xxhash64("fp", "position"), F.ceil(F.col("members") / F.lit(LIST_MEMBERS)))
    lists = met.groupBy("position", "value", part.alias("part")).agg(F.collect_list(F.struct("fp", "n", "f0", "f1")).alias("members"))

    def make():
        def step(rows):
            pairs: set[tuple[int, int]] = set()
            for members in rows["members"]:
                column = lambda c: np.array([m[c] for m in members], dtype=np.int64)  # noqa: B023, E731
                pairs |= nearest_pairs(column("fp"), column("n"), np.stack([column("f0"), column("f1")], axis=1), similarity)
            return {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}

        return step

    return verified(signed_, materialize(map_rows(lists.select("members"), "a bigint, b bigint", make).distinct(), "near-pairs"), similarity)


def verified(signed_: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the stored pairs (a, b) of ``fp`` whose shingle sets have the similarity."""
    involved = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    sets = materialize(signed_.groupBy("fp").agg(F.first("hashes").alias("hashes")).join(involved, "fp"), "shingle-sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


# --- the exact filter --------------------------------------------------------------------

#: Shingles that share a counter on average, least and most counters (of 4 bytes, broadcast), and
#: shingles that a task counts, about.
PER_COUNTER = 32
COUNTERS = (1 << 12, 1 << 22)
COUNT_AT_A_TIME = 1 << 26
#: Texts of which a task remembers that it has posted them.
REMEMBERED = 1 << 18


def shingle_counts(signed_: DataFrame) -> np.ndarray:
    """How often shingles occur, by counters that they share by hash; a power of two of them that follows the
    number of shingles up to a fixed size. Any counts give a valid order; better ones give shorter lists."""
    total = signed_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = min(COUNTERS[1], max(COUNTERS[0], 1 << (total // PER_COUNTER).bit_length()))
    tasks = max(1, -(-total // COUNT_AT_A_TIME))

    def run(batches):
        from pyspark import TaskContext

        with worker_task("simhash.counts"):
            found = np.zeros(size, dtype=np.int64)
            for batch in batches:
                values = batch.column(0).flatten().to_numpy().astype(np.uint32) & np.uint32(size - 1)
                found += np.bincount(values, minlength=size)
            schema = pa.schema([("name", pa.string()), ("slice", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
            for row in sliced("counts", found, TaskContext.get().partitionId()):
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    parts = tree_sum(signed_.select("hashes").coalesce(tasks).mapInArrow(run, "name string, slice int, part int, data binary"), tasks).collect()
    pieces = [np.frombuffer(bytes(r["data"]), "<f8") for r in sorted(parts, key=lambda r: r["slice"])]
    return np.minimum(np.concatenate(pieces), (1 << 31) - 1).astype(np.int32) if pieces else np.zeros(size, dtype=np.int32)


def prefix_length(n: int, share: float) -> int:
    """Places i from 0 on with i <= share * n, with room for rounding."""
    return min(n, int(share * n + 1e-6) + 1)


def prefix_postings(docs: DataFrame, counts: np.ndarray, *, text: str, words: int, similarity: float) -> DataFrame:
    """(token, fp, n, place, small): the shingles with which a text can meet another one; ``small`` where it can
    be the smaller of the two."""
    bound_batches(docs.sparkSession)
    shared, mask = docs.sparkSession.sparkContext.broadcast(counts), np.uint64(len(counts) - 1)
    as_larger, as_smaller = 1 - similarity, 1 - 2 * similarity / (1 + similarity)
    schema = pa.schema([("token", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("small", pa.bool_())])

    def run(batches):
        from xxhash import xxh64_intdigest

        with worker_task("simhash.prefixes"):
            counted, posted = shared.value, set()
            for batch in slices(batches):
                out: list[list[np.ndarray]] = [[] for _ in schema.names]
                with collector_off():
                    for value in batch.column(0).to_pylist():
                        fp = signed(xxh64_intdigest(b" ".join((value or "").encode("utf-8", "surrogatepass").lower().split()), 1))
                        if fp in posted:
                            continue
                        if len(posted) < REMEMBERED:
                            posted.add(fp)
                        distinct = np.unique(shingle_hashes(value, words))
                        n = len(distinct)
                        if not n:
                            continue
                        long, short = prefix_length(n, as_larger), prefix_length(n, as_smaller)
                        often = counted[(distinct & mask).astype(np.int64)]
                        first = distinct[np.lexsort((distinct, often))[:long]]
                        for column, values in zip(out, (first.view("<i8"), np.full(long, fp), np.full(long, n), np.arange(long), np.arange(long) < short), strict=True):
                            column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(text).mapInArrow(run, "token bigint, fp bigint, n int, place int, small boolean")


def left_out_pairs(postings: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of texts of different roots that can have the similarity. ``roots`` has (node, root) of
    the texts that are joined already."""
    token = Window.partitionBy("token")
    several = lambda table, column: table.withColumn("_low", F.min(column).over(token)).withColumn("_high", F.max(column).over(token)).where("_low <> _high").drop("_low", "_high")
    met = materialize(several(postings, "fp"), "met-shingles")
    rooted = met.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = materialize(several(rooted, "root"), "mixed-shingles")
    x, y = (mixed.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("fp", "n", "place", "root", "small")]) for s in "xy")
    ordered = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_fp") < F.col("x_fp")))
    rest = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    enough = rest * F.lit(1 + similarity) + F.lit(1e-6) >= F.lit(similarity) * (F.col("x_n") + F.col("y_n"))
    found = x.join(y.where("y_small"), "token").where((F.col("x_root") != F.col("y_root")) & ordered & enough)
    return found.select(F.greatest("x_fp", "y_fp").alias("a"), F.least("x_fp", "y_fp").alias("b")).distinct()


def all_similar_edges(signed_: DataFrame, docs: DataFrame, *, text: str, words: int, similarity: float) -> DataFrame:
    """(a, b): verified pairs whose components are those of all pairs of at least the similarity."""
    quick = materialize(similar_edges(signed_, similarity), "similar-edges")
    roots = materialize(connected_components(quick), "similar-roots")
    postings = prefix_postings(docs, shingle_counts(signed_), text=text, words=words, similarity=similarity)
    pairs = materialize(left_out_pairs(postings, roots, similarity), "left-out-pairs")
    return quick if pairs.isEmpty() else quick.unionByName(verified(signed_, pairs, similarity))


def similar_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, fingerprint (hex) and component_id, the smallest key that pairs of at least
    this Jaccard similarity of their word shingles reach."""
    prints = materialize(signatures(docs, key=key, text=text, words=words, carry=carry), "signatures")
    named = name_components(prints.select(key, *carry, "fp", "f0"), lambda _: all_similar_edges(prints, docs, text=text, words=words, similarity=similarity), key)
    return named.select(key, *carry, F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """``docs`` with one document per component: the one of the smallest key.

    Components are those of ``near_duplicates``, or with a similarity of ``similar_documents``. Of rows
    that repeat that key and its text one stays. Rows without a key stay unless their component
    has a key, for nothing else names one of them.
    """
    columns = docs.columns
    name, digest = fresh("_key", docs), fresh("_hash", docs)
    docs = docs.select("*", F.coalesce(F.col(key).cast("string"), F.lit("")).alias(name), F.xxhash64(F.coalesce(text, F.lit(""))).alias(digest))
    narrow = docs.select(F.col(key).alias("id"), F.col(text).alias("body"), F.col(name).alias("shown"), F.col(digest).alias("digest"))
    marked = {"key": "id", "text": "body", "carry": ("shown", "digest")}
    marks = near_duplicates(narrow, **marked) if similarity is None else similar_documents(narrow, similarity=similarity, **marked)
    kept = marks.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("shown").alias(name), F.col("digest").alias(digest)).distinct()
    return docs.join(kept, [name, digest], "left_semi").dropDuplicates([name, digest]).select(*columns)
