"""Exact deduplication through an extendible-hash index (operator 9, DataFrame functions only).

The index is a set of buckets of hashes, a directory that leads from the first bits of a hash to
its bucket, and in a bucket a chain of texts for each hash.

1. The directory starts with as many cells as the hashes would fill evenly. While a bucket holds
   more than its capacity it is doubled: only the overfull buckets are split by one more bit, the
   others keep their local depth and are found from several cells.
2. Insertion: the directory leads every text to its bucket's slot, and there texts of equal hash
   are compared byte by byte: a text that the chain holds is not entered again. A task combines its
   own texts first, so a text with a third of all rows is one row a task.
3. Look-up: the directory leads every row to its slot, and there to its place in the chain of its
   hash. Where a chain has one text that is the row's own, since every row's text was entered;
   where it has several, the row's text is compared with them byte by byte.
4. An entry's rows are counted, and the entries (slot, local depth, hash, place in the chain, digest,
   largest key, rows) are written to the shared folder, each file a range of slots; rows find
   their group there. SHA-256 is output alone and decides nothing.

The directory is broadcast up to ``BROADCAST_CELLS`` cells, whose number is known; a larger one is
joined by cell.

Edge cases: null and empty texts are the empty text, one group; very long texts are compared whole;
where several rows of a group have its largest key (repeated rows) all carry kept, and
``keep_rows`` leaves one of them; a null key ranks below every other, and a group of null keys
alone has keep_id null and all its rows kept; an empty table gives no rows. Extra columns, whatever
their names, are ignored by ``exact_groups`` and carried by ``keep_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import ascii_lower, fresh, materialize

#: Hashes a bucket holds before it is split.
BUCKET_CAPACITY = 10_000
#: A directory never grows deeper; buckets still overfull then stay so.
MAX_DEPTH = 30
HASH_BITS = 64
#: Largest directory that is broadcast, of some 24 bytes a cell; at 10,000 hashes a bucket it leads to
#: over a billion texts.
BROADCAST_CELLS = 1 << 18


def _prefix(hash_: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.lit(0).cast("bigint") if depth == 0 else F.shiftrightunsigned(hash_, HASH_BITS - depth)


def directory(hashes: DataFrame, capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, int]:
    """The directory of distinct hashes ``h`` as (cell, local_depth, slot), and its global depth.

    A cell is the first ``depth`` bits of a hash, a slot the first cell of its bucket; cells that no
    hash falls in are left out.
    """
    n = hashes.count()
    depth = min(MAX_DEPTH, (-(-n // capacity) - 1).bit_length()) if n > capacity else 0
    counted = lambda table, d: table.groupBy(_prefix(F.col("h"), d).alias("bits")).agg(F.count(F.lit(1)).alias("n")).withColumn("local_depth", F.lit(d))
    buckets, depths = materialize(counted(hashes, depth), "dedup-buckets"), [depth]
    while depth < MAX_DEPTH:
        over = buckets.where((F.col("local_depth") == depth) & (F.col("n") > capacity))
        if over.isEmpty():
            break
        inside = hashes.withColumn("bits", _prefix(F.col("h"), depth)).join(over.select("bits"), "bits", "left_semi").drop("bits")
        stay = buckets.where((F.col("local_depth") < depth) | (F.col("n") <= capacity))
        depth += 1
        buckets = materialize(stay.unionByName(counted(inside, depth)), "dedup-buckets")
        depths.append(depth)
    cells = hashes.select(_prefix(F.col("h"), depth).alias("cell")).distinct()
    levels = F.array(*[F.struct(F.lit(d).alias("local_depth"), F.shiftright("cell", depth - d).alias("bits")) for d in depths])
    paths = cells.select("cell", F.explode(levels).alias("at")).select("cell", "at.local_depth", "at.bits")
    found = paths.join(buckets.select("local_depth", "bits"), ["local_depth", "bits"])
    slot = F.expr(f"shiftleft(bits, {depth} - local_depth)")
    return materialize(found.select("cell", "local_depth", slot.alias("slot")), "dedup-directory"), depth


class Index:
    """The index of texts ``keyed``: rows (key, h, norm), where h is any hash of norm."""

    def __init__(self, keyed: DataFrame, capacity: int = BUCKET_CAPACITY):
        self.keyed = keyed
        self.rows = materialize(keyed.select("key", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "dedup-rows")
        self.cells, self.depth = directory(materialize(self.rows.select("h").distinct(), "dedup-hashes"), capacity)
        if self.cells.count() <= BROADCAST_CELLS:
            self.cells = F.broadcast(self.cells)
        texts = self.routed(keyed.select("h", "norm")).groupBy("slot", "h").agg(F.sort_array(F.collect_set("norm")).alias("texts"))
        # a text alone in its chain need not be kept: no row has to be compared with it
        links = texts.select("slot", "h", F.size("texts").alias("links"), F.when(F.size("texts") > 1, F.col("texts")).alias("texts"))
        self.chains = materialize(links, "dedup-chains")

    def routed(self, table: DataFrame) -> DataFrame:
        """``table`` with the slot and the local depth that the directory has for its ``h``."""
        return table.withColumn("cell", _prefix(F.col("h"), self.depth)).join(self.cells, "cell").drop("cell")

    def placed(self) -> DataFrame:
        """(key, h, text_sha256, slot, local_depth, chain): where each row's text is."""
        crowded = self.chains.where("links > 1").select("slot", "h", "texts")
        if crowded.isEmpty():
            return self.routed(self.rows).withColumn("chain", F.lit(1).cast("bigint"))
        sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
        place = F.coalesce(F.array_position("texts", F.col("norm")), F.lit(1).cast("bigint")).alias("chain")
        return self.routed(self.keyed).join(crowded, ["slot", "h"], "left").select("key", "h", sha, "slot", "local_depth", place)

    def entries(self, placed: DataFrame) -> DataFrame:
        """One row per distinct text; stored, each file a range of slots."""
        groups = placed.groupBy("slot", "local_depth", "h", "chain").agg(F.min("text_sha256").alias("text_sha256"), F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        return materialize(groups.repartitionByRange("slot", "h"), "dedup-index")


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    norm = ascii_lower(F.col(text))
    return docs.select(F.col(key).alias("key"), norm.alias("norm"), F.xxhash64(norm).alias("h"))


def groups_of(keyed: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """Per row of ``keyed``: key, keep_id, group_size, kept, text_sha256."""
    index = Index(keyed, capacity)
    placed = index.placed()
    entries = index.entries(placed).select("slot", "h", "chain", "keep_id", "group_size")
    found = placed.join(entries, ["slot", "h", "chain"])
    return found.select("key", "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """Per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    return groups_of(keyed_texts(docs, key, text), capacity).withColumnRenamed("key", key)


def keep_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the copies: of equal texts the row with the largest key stays.

    Of rows that repeat a kept key and text one stays, so what is left has no two equal
    texts. The texts are moved once, for the join; the last step reuses its partitioning.
    """
    name, digest = fresh("_key", docs), fresh("_sha", docs)
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kept = groups_of(keyed_texts(docs, key, text)).where("kept").select(shown(F.col("key")).alias(name), F.col("text_sha256").alias(digest)).distinct()
    sha = F.sha2(ascii_lower(F.col(text)).cast("binary"), 256)
    return docs.select("*", shown(F.col(key)).alias(name), sha.alias(digest)).join(kept, [name, digest], "left_semi").dropDuplicates([name, digest]).select(*docs.columns)
