"""Sharding by best-fit-decreasing bin packing.

Equal texts form indivisible groups. Groups of at least ``1/GRAIN`` of a mean shard are items of
their own (at most ``GRAIN`` for each shard, as their sizes add up to the whole); smaller
groups are dealt by hash into parcels of geometrically falling size, ``LEVELS * GRAIN`` a shard.
The items, bounded by the number of shards and not by the corpus, are sorted by
size and each enters the bin with the tightest remaining capacity that holds it, found in a
balanced tree of bins. For a given number of shards the least capacity at which all fit
is sought by bisection; for a given capacity the bins used are minimised greedily.

Defined results: a null text has no bytes, counts as the empty text and shares its group; rows that
repeat a doc_id, and rows without one, stay separate rows (in slot order by text where ids are equal); a group larger than a mean shard gets a shard of its own; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import materialize, table

N_SHARDS = 40
OVERHEAD = 16
GRAIN = 64
LEVELS = 9
BISECTIONS = 14


class BinTree:
    """A balanced search tree (AA tree) of (remaining capacity, bin)."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    # a node is [key, level, left, right]
    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[1] == t[3][3][1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def insert(self, key):
        def put(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key):
        def level(t):
            return t[1] if t else 0

        def drop(t, key):
            if t is None:
                return None
            if key < t[0]:
                t[2] = drop(t[2], key)
            elif t[0] < key:
                t[3] = drop(t[3], key)
            elif t[2] is None:
                return t[3]
            elif t[3] is None:
                return t[2]
            else:
                heir = t[3]
                while heir[2]:
                    heir = heir[2]
                t[0] = heir[0]
                t[3] = drop(t[3], heir[0])
            want = min(level(t[2]), level(t[3])) + 1
            if want < t[1]:
                t[1] = want
                if t[3] and want < t[3][1]:
                    t[3][1] = want
            t = self._skew(t)
            t[3] = self._skew(t[3])
            if t[3]:
                t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            t[3] = self._split(t[3])
            return t

        self.root = drop(self.root, key)

    def tightest(self, size):
        """The least (remaining, bin) that still holds size."""
        t, best = self.root, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bins of sizes that fall; None if more than ``most`` bins were needed. A size over the capacity gets a bin alone."""
    tree, bins, out = BinTree(), 0, []
    for size in sizes:
        found = tree.tightest(size)
        if found is None:
            if most is not None and bins >= most:
                return None
            left, number = capacity - size, bins
            bins += 1
        else:
            tree.remove(found)
            left, number = found[0] - size, found[1]
        if left > 0:
            tree.insert((left, number))
        out.append(number)
    return out


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """Sizes that fall, into at most ``shards`` bins of the least capacity that bisection finds."""
    alone, total, left = 0, sum(sizes), shards
    while alone < len(sizes) and left > 1 and sizes[alone] * left > total:
        total -= sizes[alone]
        alone, left = alone + 1, left - 1
    rest = sizes[alone:]
    if not rest:
        return list(range(alone))
    low = max(rest[0], -(-total // left))
    high, best = low + rest[0], None
    tight = best_fit_decreasing(rest, low, left)
    if tight is not None:
        best, high = tight, low
    while best is None:
        best = best_fit_decreasing(rest, high, left)
        high = high if best is not None else 2 * high
    for _ in range(BISECTIONS):
        if high - low <= 1:
            break
        middle = (low + high) // 2
        found = best_fit_decreasing(rest, middle, left)
        if found is None:
            low = middle
        else:
            best, high = found, middle
    return list(range(alone)) + [alone + b for b in best]


def _slim(docs: DataFrame) -> DataFrame:
    """One short row for each document: all that packing needs of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    h = F.xxhash64(digest)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        digest.alias("digest"),
        (F.lit(LEVELS) - F.length(F.bin(F.pmod(h, F.lit(1 << (LEVELS - 1)))))).cast("int").alias("level"),
        F.shiftright(h, 20).alias("spread"),
    )


def shard_documents(docs: DataFrame, n_shards: int | None = N_SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: whole groups of equal texts in near-equal shards.

    Give ``n_shards``, or a ``capacity`` in bytes to minimise the number of shards of that size.
    """
    spark = docs.sparkSession
    slim = materialize(_slim(docs.select("doc_id", "text")), "slim")
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = n_shards if n_shards is not None else max(1, -(-total // capacity))
    slim = slim.withColumn("parcel", F.pmod("spread", F.lit(shards * GRAIN)).cast("int"))
    groups = slim.groupBy("digest", "level", "parcel").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") * (shards * GRAIN) >= F.lit(total)
    items = (
        groups.select(
            F.when(large, F.col("digest")).alias("digest"),
            F.when(~large, F.col("level")).alias("level"),
            F.when(~large, F.col("parcel")).alias("parcel"),
            "bytes",
        )
        .groupBy("digest", "level", "parcel")
        .agg(F.sum("bytes").alias("bytes"))
        .collect()  # at most (LEVELS + 1) * GRAIN for each shard
    )
    items.sort(key=lambda r: (-r.bytes, r.digest or b"", r.level or 0, r.parcel or 0))
    sizes = [r.bytes for r in items]
    placed = pack_into(sizes, n_shards) if n_shards is not None else best_fit_decreasing(sizes, capacity)
    own = [(bytes(r.digest), b) for r, b in zip(items, placed) if r.digest is not None]
    dealt = [(r.level, r.parcel, b) for r, b in zip(items, placed) if r.digest is None]
    own_df = spark.createDataFrame(own, "digest binary, own_shard int")
    dealt_df = spark.createDataFrame(dealt, "level int, parcel int, dealt_shard int")
    put = (
        slim.join(F.broadcast(own_df), "digest", "left")
        .join(F.broadcast(dealt_df), ["level", "parcel"], "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "dealt_shard").alias("shard"))
    )
    # Slots run through hash buckets of doc_id and text, so that no shard is numbered by a single task.
    buckets = max(64, min(1 << 16, rows // 100_000))
    put = put.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    counts = put.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        put.withColumn("place", F.row_number().over(place))
        .join(starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).alias("slot"))
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict[str, str] = {}
