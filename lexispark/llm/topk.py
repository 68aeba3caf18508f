"""Exact top-k inner products by norm order and rotated partial sums (operator 2).

Vectors are made of integers, so scores are exact. Candidates are dealt into blocks by
descending length, and the blocks are gone through in that order, in bands that grow fourfold. After
a band every query knows the k-th best score it has so far, its threshold t; in the next one it
only meets blocks whose longest vector can reach it (|q| |c| >= t, Cauchy-Schwarz), and as lengths fall
those are the first ones of the band. Queries of similar need t / |q| share a block. A few query blocks, a group,
meet a few candidate blocks, a run, in one cell, to which both are shuffled: vectors are dealt once to a
cell, never broadcast, and a cell holds a bounded number of them. The search ends with
the band in which no query can gain any more. In a pair, coordinates are rotated by the singular
vectors of a sample, which moves most of the length to the first ones; partial sums over those
plus the product of the residual lengths bound each score, and only what reaches t is multiplied
out in integers. Within a cell t rises from block to block.

The query set is a stated part of the rows and is held against all rows in blocks; each cell
returns at most k rows per query, and the k best of those are taken by a window.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor rows
without an id; vectors of unequal size are padded with zeros, empty ones are zero; every row is a
candidate of every other, so repeated rows and rows of one id count each, also against each other,
and each is a query of its own; fewer than k candidates are all returned; ties go to the smaller
id; no queries, or an empty table, no rows; very long vectors are read whole; components beyond
64 bits are saturated and such scores are summed in unbounded integers, then clamped; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import materialize

#: Vectors of a candidate block, of a query block, and of the rotation's sample.
BLOCK = 4096
QUERY_BLOCK = 512
SAMPLE = 2000
#: A band ends at so many times the blocks before it; lengths by which a band's blocks are found.
GROWTH = 4
EDGES = 1024
#: Groups of query blocks and runs of a band's candidate blocks that are aimed at; blocks of a group and of a run at most.
GROUPS = 8
RUNS = 32
GROUP_BLOCKS = 64
RUN_BLOCKS = 16
#: Share of a pair of blocks above which survivors are taken from one matrix product.
DENSE = 0.02
LONG = (1 << 63) - 1


def quantised(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, id, v array<bigint>, norm): floor(scale * x) of the vectors that take part; to be
    written before row is used."""
    x = F.col(vector)
    usable = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    ints = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")))
    rows = table.where(usable).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), ints.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    return rows.withColumn("norm", norm)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as an int64 matrix, short rows padded with zeros."""
    out = np.zeros((len(column), width), dtype=np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    mask = np.arange(width)[None, :] < lengths[:, None]
    out[mask] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def exact_products(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Integer inner products of q[rows] and c[cols], clamped to 64 bits."""
    largest = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if largest < 2.0**53 and len(rows) > DENSE * len(q) * len(c):
        # all partial sums are integers below 2**53, so the float product is exact
        return (q.astype(np.float64) @ c.astype(np.float64).T)[rows, cols].astype(np.int64)
    if largest < 2.0**62:
        out = np.empty(len(rows), dtype=np.int64)
        for at in range(0, len(rows), 65_536):
            part = slice(at, at + 65_536)
            out[part] = np.einsum("ij,ij->i", q[rows[part]], c[cols[part]])
        return out
    sums = (sum(int(a) * int(b) for a, b in zip(q[i], c[j], strict=True)) for i, j in zip(rows, cols, strict=True))
    return np.fromiter((max(-LONG - 1, min(LONG, s)) for s in sums), np.int64, len(rows))


def best_k(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row number: by score descending, then smaller id."""
    order = np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == -LONG - 1 else -scores, rows))
    ordered = rows[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    place = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return order[place < k]


class Block:
    """Row numbers, ids, integers and lengths of some vectors, and the scores that queries need."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, bound: np.ndarray | None = None):
        self.rows, self.ids, self.v, self.bound = rows, ids, v, bound
        self.f = v.astype(np.float64)
        self.norm = np.sqrt((self.f * self.f).sum(axis=1))
        self._rotated: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def unpacked(cls, row: dict, width: int) -> Block:
        rows = np.frombuffer(row["rows"], "<i8")
        v = np.frombuffer(row["v"], f"<i{len(row['v']) // (len(rows) * width)}").reshape(-1, width)
        return cls(rows, np.frombuffer(row["ids"], "<i8"), v.astype(np.int64), np.frombuffer(row["bound"], "<f8").copy())

    def rotated(self, rotation: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Leading rotated coordinates and the length of the rest, made once."""
        if self._rotated is None:
            lead = self.f @ rotation[:, :first]
            rest = np.maximum(self.norm**2 - (lead * lead).sum(axis=1), 0.0)
            self._rotated = lead, np.sqrt(rest)
        return self._rotated

    def raise_bound(self, rows: np.ndarray, scores: np.ndarray, k: int) -> None:
        """Take the k-th score of each row number that has so many, from the order of ``best_k``, as bound."""
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        full = starts[np.diff(np.r_[starts, len(rows)]) >= k]
        kth = scores[full + k - 1].astype(np.float64)
        order = np.argsort(self.rows)
        at = order[np.searchsorted(self.rows, rows[full], sorter=order)]
        self.bound[at] = np.maximum(self.bound[at], kth - np.abs(kth) * 1e-12)


def survivors(q: Block, c: Block, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) whose bound reaches the query's threshold."""
    first = max(1, min(q.v.shape[1], max(8, q.v.shape[1] // 4)))
    slack = 1e-9 * q.norm[:, None] * c.norm[None, :] + 1e-6
    alive = q.norm[:, None] * c.norm[None, :] + slack >= q.bound[:, None]
    reach = alive.any(axis=0)
    used = np.flatnonzero(reach)
    if not len(used):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    (ql, qr), (cl, cr) = q.rotated(rotation, first), c.rotated(rotation, first)
    bound = ql @ cl[used].T + qr[:, None] * cr[used][None, :] + slack[:, used]
    rows, cols = np.nonzero((bound >= q.bound[:, None]) & alive[:, used])
    return rows, used[cols]


def top_of(q: Block, c: Block, rotation: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query's row, query's id, candidate's id, score): each query's k best in a block that reach
    its bound."""
    rows, cols = survivors(q, c, rotation)
    other = q.rows[rows] != c.rows[cols]
    rows, cols = rows[other], cols[other]
    scores = exact_products(q.v, c.v, rows, cols)
    enough = scores >= q.bound[rows]
    rows, cols, scores = rows[enough], cols[enough], scores[enough]
    best = best_k(rows, c.ids[cols], scores, k)
    return q.rows[rows[best]], q.ids[rows[best]], c.ids[cols[best]], scores[best]


def top_of_cell(queries: list[Block], candidates: list[Block], rotation: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """The same for each query block over all candidate blocks, whose scores raise its bound one after the other."""
    out = []
    for q in queries:
        best = tuple(np.empty(0, np.int64) for _ in range(4))
        for c in candidates:
            found = top_of(q, c, rotation, k)
            if len(found[0]):
                both = tuple(map(np.concatenate, zip(best, found, strict=True)))
                first = best_k(both[0], both[2], both[3], k)
                best = tuple(x[first] for x in both)
                q.raise_bound(best[0], best[3], k)
        out.append(best)
    return out


def narrow(v: np.ndarray) -> np.ndarray:
    """The integers in the fewest bytes that hold all of them."""
    low, high = (int(v.min()), int(v.max())) if v.size else (0, 0)
    return v.astype(next(f"<i{n}" for n in (1, 2, 4, 8) if -(1 << (8 * n - 1)) <= low and high < 1 << (8 * n - 1)))


_BLOCK_SCHEMA = "part int, serial bigint, edge double, rows binary, ids binary, v binary, bound binary"


def _block_rows(width: int, size: int, queries: bool):
    """mapInArrow function: vectors of a task, in order, into block rows. The edge of candidates is
    their greatest length, that of queries the least length that any of them needs."""
    schema = pa.schema([("part", pa.int32()), ("serial", pa.int64()), ("edge", pa.float64())] + [(c, pa.binary()) for c in ("rows", "ids", "v", "bound")])

    def run(batches):
        part, serial, held, count = TaskContext.get().partitionId(), 0, [], 0

        def emit(rows: pa.Table):
            nonlocal serial
            number, ids, v = rows["row"].to_numpy(), rows["id"].to_numpy(), _matrix(rows["v"].combine_chunks(), width)
            bound = rows["bound"].to_numpy() if queries else np.zeros(len(ids))
            edge = float(rows["need"].to_numpy().min()) if queries else float(rows["norm"].to_numpy().max())
            packed = {"rows": number.astype("<i8"), "ids": ids.astype("<i8"), "v": narrow(v), "bound": bound.astype("<f8")}
            yield pa.RecordBatch.from_pydict({"part": [part], "serial": [serial], "edge": [edge]} | {c: [x.tobytes()] for c, x in packed.items()}, schema=schema)
            serial += 1

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            while count >= size:
                rows = pa.concat_tables(held)
                yield from emit(rows.slice(0, size))
                held, count = [rows.slice(size)], count - size
        if count:
            yield from emit(pa.concat_tables(held))

    return run


def rotation_of(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of a bounded sample; any rotation gives exact results."""
    rows = vectors.orderBy(F.xxhash64("id", "row"), "row").limit(SAMPLE).select("v").toArrow()
    if not rows.num_rows:
        return np.eye(width)
    x = _matrix(rows["v"].combine_chunks(), width).astype(np.float64)
    scale = np.abs(x).max() or 1.0
    return np.linalg.svd(x / scale, full_matrices=True)[2].T


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with their number ``at`` in the order of parts, which is that of their lengths."""
    counts = blocks.groupBy("part").agg((F.max("serial") + 1).alias("n")).orderBy("part").collect()  # a row per task
    firsts = np.cumsum([0, *(r["n"] for r in counts)])[:-1].tolist()
    offsets = blocks.sparkSession.createDataFrame([(r["part"], first) for r, first in zip(counts, firsts, strict=True)], "part int, first bigint")
    return blocks.join(F.broadcast(offsets), "part").withColumn("at", F.col("first") + F.col("serial")).drop("first")


def exact_top_k(table: DataFrame, k: int = 20, *, key: str = "vec_id", vector: str = "embedding", every: int = 20, scale: int = 64, trace: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose id is divisible by ``every``. To ``trace``, if
    given, each band adds (pairs of blocks that met, pairs of blocks)."""
    spark = table.sparkSession
    vectors = materialize(quantised(table, key=key, vector=vector, scale=scale), "vectors")
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0)  # a vector without components is zero
    rotation = spark.sparkContext.broadcast(rotation_of(vectors, width))
    by_length = (F.desc("norm"), F.asc("row"))
    blocks = vectors.repartitionByRange(*by_length).sortWithinPartitions(*by_length).mapInArrow(_block_rows(width, BLOCK, False), _BLOCK_SCHEMA)
    blocks = materialize(blocks, "candidate-blocks")
    total = blocks.count()
    blocks = numbered(blocks)
    queries = vectors.where(F.col("id") % every == 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        unpacked = [[Block.unpacked(row, width) for row in t.sort_by("at").to_pylist()] for t in (left, right)]
        found = top_of_cell(*unpacked, rotation.value, k)
        columns = map(np.concatenate, zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "score"])

    schema = "row bigint, query_id bigint, vec_id bigint, score bigint"
    best = spark.createDataFrame([], schema + ", rank int")
    low, high = 0, 1
    while low < total:
        # the k-th best so far; rounding of large scores only loosens it
        kth = best.where(F.col("rank") == k).select("row", (F.col("score") - F.abs("score") * 1e-12).cast("double").alias("bound"))
        need = F.when(F.col("norm") > 0, F.col("bound") / F.col("norm")).otherwise(F.lit(float("-inf")))
        known = queries.join(kth, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))).withColumn("need", need - F.abs(need) * 1e-9 - 1e-6)
        known = known.withColumn("need", F.when(F.isnan("need"), F.lit(float("-inf"))).otherwise(F.col("need")))
        asked = known.repartitionByRange("need", "row").sortWithinPartitions("need", "row").mapInArrow(_block_rows(width, QUERY_BLOCK, True), _BLOCK_SCHEMA)
        asked = numbered(materialize(asked, "query-blocks"))

        # a run is a cell's blocks; an edge stands for some runs, so that there are few edges at any number of runs
        span = max(1, min(RUN_BLOCKS, (high - low) // RUNS))
        runs = -(-(high - low) // span)
        step = -(-runs // EDGES)
        band = blocks.where(F.col("at").between(low, high - 1)).withColumn("run", F.expr(f"(at - {low}) div {span}"))
        edges = [r["edge"] for r in band.where((F.col("at") - low) % (step * span) == 0).orderBy("at").select("edge").collect()]  # EDGES at most
        reach = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e >= F.col("edge")))
        met = asked.withColumn("reach", reach)
        reached = met.groupBy("reach").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")).collect()  # a row for each edge at most
        pairs, asking = sum(r["reach"] * r["n"] for r in reached), sum(r["n"] for r in reached)
        if trace is not None:
            trace.append((pairs, asking * len(edges)))
        if not pairs:
            break
        # the first groups need least and reach farthest, so a run meets the groups up to a last one
        size = max(1, min(GROUP_BLOCKS, -(-asking // GROUPS)))
        last = [max((r["last"] // size for r in reached if r["reach"] > e), default=-1) for e in range(len(edges))]
        farthest = F.least(F.col("reach").cast("bigint") * step, F.lit(runs))
        cells = met.where("reach > 0").select("at", "rows", "ids", "v", "bound", F.expr(f"at div {size}").alias("group"), F.explode(F.sequence(F.lit(0).cast("bigint"), farthest - 1)).alias("run"))
        deepest = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in last]), (F.expr(f"run div {step}") + 1).cast("int"))
        dealt = band.withColumn("deepest", deepest).where("deepest >= 0")
        dealt = dealt.select("at", "rows", "ids", "v", "bound", "run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deepest"))).alias("group"))
        met_in = cells.groupBy("group", "run").cogroup(dealt.groupBy("group", "run")).applyInArrow(score, schema)
        found = met_in.unionByName(best.select("row", "query_id", "vec_id", "score"))
        place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
        best = materialize(found.withColumn("rank", place).where(F.col("rank") <= k), "best-so-far")
        low, high = high, min(total, high * GROWTH)
    return best.select("query_id", "rank", "vec_id", "score")
