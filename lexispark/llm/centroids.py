"""Centroid clustering with exact integer distances (operator 12).

Vectors are made of whole numbers, floor(scale * x). A task turns each Arrow batch into a block and
expands the squared distances to all centroids as |x|^2 - 2 x.c + |c|^2, one matrix product in float64
for a block. The result is exact as long as no sum on the way reaches 2^53; the sizes of a row's and
of the centroids' components bound these sums beforehand, and a row beyond the bound is computed in
unbounded integers instead. So no distance is rounded and no tie is decided by rounding.

Each task adds up its vectors by nearest centroid: it sends on one row per centroid, whatever it has read. These
rows are combined by an RDD's treeAggregate, in which no task meets more than a few parts, and
``k`` sums and counts come to the driver, which divides them (downwards, in integers). Centroids go to the tasks
with the next round, k times the vectors' size. A hot vector or a hot cluster costs nothing extra,
as no row is moved.

Edge cases: vectors that are null, of another size, or hold null or non-finite components take no part
and are not returned; a null key has the starting hash of the text ``<seed>:``; repeated rows and rows of one id
count each; of equal starting hashes the smaller vector comes first, and equal vectors start
equal centroids, of which the first gets all; with fewer vectors than ``k`` there are as many centroids
as vectors; an empty centroid stays; components of any finite size are exact, and distances and sums
of distances beyond 64 bits are given as the largest long; an empty table gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import materialize, worker_task

#: Rows of a block, hence of its matrix of distances.
BLOCK = 2048
#: Whole numbers below it are exact in float64.
EXACT = 1 << 53
LONG = (1 << 63) - 1
#: Levels of the tree in which the tasks' sums are combined.
DEPTH = 3

Centroids = list[list[int]]


def whole_vectors(table: DataFrame, *, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """(key, v array<double>): floor(scale * x) of the vectors that take part. ``scale`` is a power of two,
    so the product is exact, and a double of 2^53 or more is whole already."""
    x = F.col(vector)
    usable = x.isNotNull() & (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def whole(e):
        y = F.lit(float(scale)) * e.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return table.where(usable).select(F.col(key).alias("key"), F.transform(x, whole).alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> Centroids:
    """The k vectors with the smallest SHA-256 of ``<seed>:<key>``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    return [[int(e) for e in r.v] for r in vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()]


def nearest(block: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, list[int]]:
    """For each row of whole float64 numbers the nearest centroid (of equal ones the first) and its exact
    squared distance."""
    n, d = block.shape
    most = max((abs(e) for c in centroids for e in c), default=0)
    sizes = np.abs(block).max(axis=1, initial=0)
    # what the three terms may add up to; half the limit, as this bound is rounded itself
    fits = d * (sizes + float(most)) ** 2 < EXACT / 2 if most < EXACT else np.zeros(n, dtype=bool)
    label, distance = np.zeros(n, dtype=np.int64), [0] * n
    at = np.flatnonzero(fits)
    if len(at):
        x, c = block[at], np.array(centroids, dtype=np.float64)
        squares = np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
        label[at] = squares.argmin(axis=1)
        if len(at) == n:
            return label, squares[np.arange(n), label].astype(np.int64).tolist()
        for i, s in zip(at, squares[np.arange(len(at)), label[at]], strict=True):
            distance[i] = int(s)
    for i in np.flatnonzero(~fits):
        row = [int(e) for e in block[i]]
        far = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids]
        distance[i], label[i] = min((s, j) for j, s in enumerate(far))
    return label, distance


def _blocks(batches, column: str, size: int):
    """(record batch, its vectors as a float64 matrix) of at most ``BLOCK`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column(part.schema.names.index(column)).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)


def cluster_sums(block: np.ndarray, label: np.ndarray, k: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors, exact sums of their components) of the clusters that have any."""
    if np.abs(block).max(initial=0) * len(block) < EXACT:
        member = np.zeros((k, len(block)))
        member[label, np.arange(len(block))] = 1
        sums = (member @ block).astype(np.int64).tolist()
    else:
        sums = [[sum(int(e) for e in column) for column in block[label == j].T] for j in range(k)]
    counts = np.bincount(label, minlength=k).tolist()
    return [(j, counts[j], sums[j]) for j in range(k) if counts[j]]


def added(total: dict, part: tuple[int, int, list[int]]) -> dict:
    cluster, n, sums = part
    if cluster in total:
        m, before = total[cluster]
        n, sums = n + m, [a + b for a, b in zip(before, sums, strict=True)]
    total[cluster] = (n, sums)
    return total


def merged(one: dict, other: dict) -> dict:
    for cluster, (n, sums) in other.items():
        added(one, (cluster, n, sums))
    return one


def moved(vectors: DataFrame, centroids: Centroids, size: int) -> Centroids:
    """Centroids after one round: the floored mean of their vectors, or where they were."""

    def run(batches):
        with worker_task("centroids"):
            total: dict = {}
            for _, block in _blocks(batches, "v", size):
                for part in cluster_sums(block, nearest(block, centroids)[0], len(centroids)):
                    added(total, part)
            # sums can pass 64 bits, so they travel as decimal numbers in text
            columns = [list(total), [n for n, _ in total.values()], [[str(s) for s in sums] for _, sums in total.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n bigint, sums array<string>")
    total = parts.rdd.map(lambda r: (r.cluster, r.n, [int(s) for s in r.sums])).treeAggregate({}, added, merged, DEPTH)
    return [[s // total[j][0] for s in total[j][1]] if j in total else c for j, c in enumerate(centroids)]


def assigned(vectors: DataFrame, centroids: Centroids, size: int) -> DataFrame:
    """(key, cluster, distance) of every vector."""
    schema = T.StructType([vectors.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        with worker_task("centroids"):
            for part, block in _blocks(batches, "v", size):
                label, distance = nearest(block, centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label.astype(np.int32)), pa.array([min(s, LONG) for s in distance], pa.int64())], names=["key", "cluster", "distance"])

    return vectors.select("key", "v").mapInArrow(run, schema)


def cluster(table: DataFrame, *, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector: key, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark: SparkSession = table.sparkSession
    vectors = materialize(whole_vectors(table, key=key, vector=vector, size=size, scale=scale), "centroid-vectors")
    centroids = starts(vectors, k, seed)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, size)
    stored = materialize(assigned(vectors, centroids, size), "centroid-labels")
    sums = [(c, int(s)) for c, s in stored.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()]  # one row a cluster
    inertia = min(sum(s for _, s in sums), LONG)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, min(s, LONG), inertia, shas[c]) for c, s in sums], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return stored.join(F.broadcast(facts), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
