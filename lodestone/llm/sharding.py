"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible: their sizes are summed by a 128-bit hash of the text before anything is packed. A group
of more than a `PARCELS`-th of all bytes is a unit of its own, so there are fewer than `PARCELS` of those. Smaller groups are dealt
by their hash to one of `PARCELS` parcels, which are units too: about 1/4096 of a shard each, however many groups there are.
So the driver packs a bounded number of sizes. Units sorted by size, largest first, enter the bin with the least room that
still takes them, found in a balanced (AA) tree keyed by room. Units above the mean fill get a shard of their own; the
capacity of the others is the smallest that best fit meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, numbered, settle, text_of

PARCELS = 65_536


class _Room:
    """An AA tree of (room, bin): a balanced search tree with insert, delete and the least entry at or above a key."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # [key, level, left, right]

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            a = t[2]
            t[2], a[3] = a[3], t
            return a
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[3][3][1] == t[1]:
            a = t[3]
            t[3], a[2] = a[2], t
            a[1] += 1
            return a
        return t

    def insert(self, key):
        def put(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def delete(self, key):
        def level(t):
            return t[1] if t else 0

        def cut(t, key):
            if t is None:
                return None
            if key != t[0]:
                side = 2 if key < t[0] else 3
                t[side] = cut(t[side], key)
            elif t[2] is None or t[3] is None:
                return t[2] or t[3]
            else:
                nxt = t[3]
                while nxt[2]:
                    nxt = nxt[2]
                t[0] = nxt[0]
                t[3] = cut(t[3], nxt[0])
            if min(level(t[2]), level(t[3])) < t[1] - 1:
                t[1] -= 1
                if level(t[3]) > t[1]:
                    t[3][1] = t[1]
                t = self._skew(t)
                if t[3]:
                    t[3] = self._skew(t[3])
                    if t[3][3]:
                        t[3][3] = self._skew(t[3][3])
                t = self._split(t)
                if t[3]:
                    t[3] = self._split(t[3])
            return t

        self.root = cut(self.root, key)

    def tightest(self, size):
        """The least (room, bin) with room >= size, or None."""
        best, t, key = None, self.root, (size, -1)
        while t:
            if t[0] >= key:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit(sizes: list[int], bins: int, capacity: int) -> list[int] | None:
    """Bin of each size, the sizes being in falling order; None if they don't fit `bins` bins of `capacity`."""
    tree, out, opened = _Room(), [], 0
    for size in sizes:
        found = tree.tightest(size)
        if found is None:
            if opened == bins or size > capacity:
                return None
            found = (capacity, opened)
            opened += 1
        else:
            tree.delete(found)
        tree.insert((found[0] - size, found[1]))
        out.append(found[1])
    return out


def pack(units: dict[int, int], bins: int) -> dict[int, int]:
    """Bin (0 to bins - 1) of each unit of {unit: size}, with the sums of the bins as equal as whole units allow."""
    order = sorted(units, key=lambda u: (-units[u], u))
    left, total, out, first = bins, sum(units.values()), {}, 0
    while left > 1 and first < len(order) and units[order[first]] * left > total:
        out[order[first]] = bins - left
        total -= units[order[first]]
        left, first = left - 1, first + 1
    rest = order[first:]
    if not rest:
        return out
    sizes = [units[u] for u in rest]
    low = max(-(-total // left), sizes[0])
    step, capacity, found = max(1, low // 8192), low, None
    while (found := best_fit(sizes, left, capacity)) is None:
        low, capacity, step = capacity + 1, capacity + step, step * 2
    for _ in range(8):  # between the last that failed and the first that fits
        if low >= capacity:
            break
        middle = (low + capacity) // 2
        if (tried := best_fit(sizes, left, middle)) is None:
            low = middle + 1
        else:
            capacity, found = middle, tried
    return out | {u: bins - left + b for u, b in zip(rest, found, strict=True)}


def shard(docs: DataFrame, n_shards: int = 16, parcels: int = PARCELS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, n_shards.

    size is the text's UTF-8 bytes plus 1, a null text counting as empty. Equal texts get one shard. An empty table gives an
    empty result; repeated rows stay, each with its own slot; other columns are not read. Slots follow no stated order.
    """
    text = text_of()
    base = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"),
    )
    base = settle(base, "shard-base")
    groups = base.groupBy("h", "g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    groups = settle(groups, "shard-groups")
    total = groups.agg(F.sum("size"), F.sum("n")).first()
    alone = groups.where(F.col("size") * parcels > (total[0] or 0))
    small = groups.join(F.broadcast(alone.select("h", "g")), ["h", "g"], "left_anti")
    large = alone.select("h", "g", "size").orderBy("h", "g").collect()  # fewer than `parcels` rows
    parcel = F.pmod("h", F.lit(parcels)).cast("int")
    units = small.groupBy(parcel.alias("parcel")).agg(F.sum("size").alias("size")).collect()  # at most `parcels` rows
    placed = pack({r["parcel"]: r["size"] for r in units} | {parcels + i: r["size"] for i, r in enumerate(large)}, n_shards)
    spark = docs.sparkSession
    field = lambda n, t: T.StructField(n, t())
    where = spark.createDataFrame([(u, b) for u, b in sorted(placed.items()) if u < parcels], T.StructType([field("parcel", T.IntegerType), field("of_parcel", T.IntegerType)]))
    own = spark.createDataFrame([(r["h"], r["g"], placed[parcels + i]) for i, r in enumerate(large)], T.StructType([field("h", T.LongType), field("g", T.LongType), field("of_group", T.IntegerType)]))
    rows = base.join(F.broadcast(own), ["h", "g"], "left").withColumn("parcel", parcel).join(F.broadcast(where), "parcel", "left")  # at most `parcels` rows each
    rows = rows.withColumn("shard", F.coalesce("of_group", "of_parcel"))
    rows = numbered(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32")], total[1] or 0, "slot")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.lit(n_shards).alias("n_shards"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document into 16 shards of near equal bytes; nulls, empty texts, ties and repeated rows as in `shard`."""
    return shard(load(spark, sf_dir, "documents"))
