"""Blocked matrix products: rows of vectors times a matrix that no task holds whole.

Both sides are cut into tiles of rows, of inner coordinates and of outputs. A tile of rows meets the
weight tiles of its inner range, one for each range of outputs, by equality; partial products of the inner
ranges are added up in a tree, and a block's outputs are put together again. What is shuffled follows
the tiles: each row tile once for every range of outputs, each weight tile once for every group of row
blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.model.gradients import tree_sum
from lexispark.operators.order import with_row_index
from lexispark.session import store

#: Values of a tile (2 MB), inner coordinates of one, values of a block's outputs or of a strip of weights, and
#: blocks of rows that meet one copy of a weight tile.
TILE = 1 << 18
INNER = 512
STRIP = 1 << 22
BLOCKS = 64


@dataclass(frozen=True)
class Tiling:
    """Sizes of the tiles of a product of [n, inner] and [inner, outer]."""

    inner: int
    outer: int
    tile: int = TILE

    @property
    def inner_size(self) -> int:
        return max(1, min(self.inner, INNER, self.tile))

    @property
    def outer_size(self) -> int:
        return max(1, min(self.outer, self.tile // self.inner_size, STRIP // max(1, self.inner)))

    @property
    def rows(self) -> int:
        return max(1, min(4096, self.tile // max(self.inner_size, self.outer_size), STRIP // max(1, self.outer)))

    def ranges(self, outer: bool = False) -> list[tuple[int, int]]:
        n, size = (self.outer, self.outer_size) if outer else (self.inner, self.inner_size)
        return [(a, min(a + size, n)) for a in range(0, n, size)]


_TILES = "block bigint, inner int, data binary"


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype="<f8").tobytes()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if (bad := column.value_lengths().to_numpy() != width).any():
        raise ValueError(f"{int(bad.sum())} vectors are not of length {width}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def row_tiles(rows: DataFrame, vector: str, key: list[str], tiling: Tiling) -> DataFrame:
    """(block, inner, data): tiles of blocks of rows, and with inner -1 the block's keys; stored."""

    def run(batches):
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, tiling.rows):
                part = batch.slice(at, tiling.rows)
                x = _matrix(part.column(len(key)), tiling.inner)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, keys := part.select(range(len(key))).schema) as stream:
                    stream.write_batch(pa.RecordBatch.from_arrays(part.columns[: len(key)], schema=keys))
                tiles = [(-1, sink.getvalue().to_pybytes()), *((i, _bytes(x[:, a:b])) for i, (a, b) in enumerate(tiling.ranges()))]
                yield pa.RecordBatch.from_pydict({"block": [block] * len(tiles), "inner": [i for i, _ in tiles], "data": [d for _, d in tiles]}, schema=pa.schema([("block", pa.int64()), ("inner", pa.int32()), ("data", pa.binary())]))
                block += 1

    return store(rows.select(*key, vector).mapInArrow(run, _TILES), "row-tiles")


def weight_tiles(weights: DataFrame, tiling: Tiling) -> DataFrame:
    """(outer, inner, data) of weights (o, w), transposed; outputs are in order of ``o``."""

    def cut(key: tuple, strip: pa.Table) -> pa.Table:
        strip = strip.sort_by("at")
        w = _matrix(strip["w"].combine_chunks(), tiling.inner)
        tiles = [_bytes(w[:, a:b].T) for a, b in tiling.ranges()]
        return pa.table({"outer": pa.array([key[0].as_py()] * len(tiles), pa.int32()), "inner": pa.array(range(len(tiles)), pa.int32()), "weight": pa.array(tiles, pa.binary())})

    numbered = with_row_index(weights.select("o", "w"), ["o"], "at").withColumn("outer", F.expr(f"at div {tiling.outer_size}").cast("int"))
    return numbered.groupBy("outer").applyInArrow(cut, "outer int, inner int, weight binary")


def blocked_product(rows: DataFrame, vector: str, weights: DataFrame, out: str, *, key: list[str], inner: int, outer: int, tile: int = TILE) -> DataFrame:
    """(key, out array<double>): each row's vector of length ``inner`` times the ``outer`` weight rows (o, w); all
    outputs of a null vector are null."""
    tiling = Tiling(inner, outer, tile)
    tiles = row_tiles(rows.where(F.col(vector).isNotNull()), vector, key, tiling)
    blocks = tiles.where("inner = -1").count()
    copies = max(1, -(-blocks // BLOCKS))
    outers, inners = len(tiling.ranges(outer=True)), len(tiling.ranges())
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(copies)).cast("int")
    left = tiles.where("inner >= 0").select("block", "inner", "data", salt("block").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(outers - 1))).alias("outer"))
    right = weight_tiles(weights, tiling).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def multiply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, n, m, x, w = (batch.column(c)[i].as_py() for c in range(5))
                a, b = tiling.ranges()[n]
                product = np.frombuffer(x, "<f8").reshape(-1, b - a) @ np.frombuffer(w, "<f8").reshape(b - a, -1)
                yield pa.RecordBatch.from_pydict({"name": [str(block)], "slice": [m], "part": [n], "data": [_bytes(product)]}, schema=pa.schema([("name", pa.string()), ("slice", pa.int32()), ("part", pa.int32()), ("data", pa.binary())]))

    met = left.join(right, ["inner", "outer", "salt"]).select("block", "inner", "outer", "data", "weight")
    summed = tree_sum(met.mapInArrow(multiply, "name string, slice int, part int, data binary"), inners)
    kinds = T.StructType([*[rows.schema[k] for k in key], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def assemble(table: pa.Table) -> pa.Table:
        parts = dict(zip(table["outer"].to_pylist(), table["data"].to_pylist(), strict=True))
        keys = pa.ipc.open_stream(parts.pop(-1)).read_all()
        n = keys.num_rows
        y = np.concatenate([np.frombuffer(parts[m], "<f8").reshape(n, -1) for m in sorted(parts)], axis=1)
        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
        return keys.append_column(out, values)

    pieces = summed.select(F.col("name").cast("bigint").alias("block"), F.col("slice").alias("outer"), "data")
    whole = pieces.unionByName(tiles.where("inner = -1").select("block", F.col("inner").alias("outer"), "data")).groupBy("block").applyInArrow(lambda t: assemble(t.select(["outer", "data"])), kinds)
    missing = rows.where(F.col(vector).isNull()).select(*key, F.array_repeat(F.lit(None).cast("double"), outer).alias(out))
    return whole.unionByName(missing)
