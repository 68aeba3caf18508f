"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two equi-joins over the edges; after O(log n) rounds each
component is a star around its smallest node. Nothing but a count and a checksum of the edges
comes to the driver, and each round's edges are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import drop_materialized, materialize


def _oriented(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b, each once; loops go."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's smallest node.

    ``edges`` has two columns of one orderable type, in any direction, repeats allowed.
    """
    first, second = edges.columns
    now = materialize(_oriented(edges.toDF("a", "b")), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _oriented(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest)
        after = materialize(_oriented(small), "edges")
        state = _state(after)
        drop_materialized(now)
        now, done = after, state == seen
        seen = state
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
