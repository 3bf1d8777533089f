"""Sharding by best-fit-decreasing bin packing: groups of equal texts stay whole, shards get near-equal bytes.

A group above the even share of a shard has a shard of its own; that is repeated with the bytes and shards that are left
until no group is above. All other groups are items, by falling size, each into the bin with the tightest room that holds it,
found in a balanced tree. Groups of one size are alike, so the driver packs the table of different sizes and their counts: a
bin takes as many groups of a size as it holds before the next tightest is looked up, which is the same rule. Different sizes
that add up to no more than all bytes are at most the root of twice the bytes: 245,000 for 30 GB, 14 million for 100 TB, of 16
bytes each and 24 for where they go (3 million are packed in a minute with 0.4 GB). The capacity is searched from the even share on, so every bin is near full. The groups of a size then take
their bins by their rank among equals, counted in two steps.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, cut, maybe_broadcast

#: Parts of a shard, or of the groups of one size, that are numbered each on their own.
RUNS = 1024
#: Rows of a group from which it is joined by broadcast instead of shuffled to one task, and the most of them that are.
HOT_ROWS, BROADCAST_ROWS = 20_000, 1 << 18


class _RoomTree:
    """A treap of (room, bin): insert, and take out the least room that suffices, in logarithmic time."""

    __slots__ = ("root", "state")

    def __init__(self) -> None:
        self.root, self.state = None, 0x2545F491

    def _split(self, node, key):
        """Nodes below ``key`` and the others; a node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, room: int, place: int) -> None:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) & (1 << 64) - 1
        left, right = self._split(self.root, (room, place))
        self.root = self._merge(self._merge(left, [(room, place), self.state >> 20, None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest (room, bin) with room >= size, removed; None if there is none."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node, above = right, None
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            right = node[3]
        else:
            above[2] = node[3]
        self.root = self._merge(left, right)
        return node[0]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, bins numbered as they are opened; an item over ``capacity`` gets a bin of its own."""
    tree, bins, opened = _RoomTree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = (max(capacity, sizes[i]), opened)
            opened += 1
        room, bins[i] = found
        tree.insert(room - sizes[i], bins[i])
    return bins


def own_shards(falling: list[int], total: int, shards: int) -> tuple[int, int]:
    """How many of some falling sizes are above the even share of what is left, one after the other, and the total without them."""
    n = 0
    while n < len(falling) and falling[n] * (shards - n) > total:
        total -= falling[n]
        n += 1
    return n, total


def _each(sizes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, size, count) of arrays, without a list of them all."""
    for a in range(0, len(sizes), 1 << 16):
        yield from zip(range(a, a + (1 << 16)), sizes[a : a + (1 << 16)].tolist(), counts[a : a + (1 << 16)].tolist(), strict=False)


def fill(sizes: np.ndarray, counts: np.ndarray, capacity: int, most: int) -> np.ndarray | None:
    """Rows (place in sizes, bin, groups of that size in it) by best fit decreasing over falling sizes; None if it takes more than ``most`` bins."""
    tree, runs, opened = _RoomTree(), array("q"), 0
    for i, size, left in _each(sizes, counts):
        while left:
            found = tree.take(size)
            if found is None:
                if opened == most:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            room, place = found
            n = min(left, room // size)
            runs.extend((i, place, n))
            tree.insert(room - n * size, place)
            left -= n
    return np.frombuffer(runs, np.int64).reshape(-1, 3) if runs else np.zeros((0, 3), np.int64)


def pack_counts(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """Rows (place in falling ``sizes``, bin, groups), by place: those above the even share alone, the others for the smallest
    capacity found that best fit decreasing can keep."""
    largest = [s for s, n in zip(sizes[:shards].tolist(), counts[:shards].tolist(), strict=True) for _ in range(min(n, shards))][:shards]
    alone, left = own_shards(largest, int((sizes * counts).sum()), shards)
    first, rest, k = [], counts.copy(), 0
    for place in range(alone):
        while not rest[k]:
            k += 1
        first.append((k, place, 1))
        rest[k] -= 1
    low, step = -(-left // (shards - alone)), 1
    best, high = fill(sizes, rest, low, shards - alone), low
    while best is None:  # ever larger steps, then between the last two
        low, high, step = high + 1, low + step, 2 * step
        best = fill(sizes, rest, high, shards - alone)
    while low < high:
        middle = (low + high) // 2
        found = fill(sizes, rest, middle, shards - alone)
        if found is not None:
            best, high = found, middle
        else:
            low = middle + 1
    runs = np.concatenate([np.array(first, np.int64).reshape(-1, 3), best + np.array([0, alone, 0])])
    return runs[np.argsort(runs[:, 0], kind="stable")]


def pack(sizes: list[int], shards: int) -> list[int]:
    """The bin of each item in 0 .. shards - 1, by pack_counts; equal sizes take their bins in order of place."""
    falling, counts = np.unique(np.array(sizes, np.int64), return_counts=True)
    runs = pack_counts(falling[::-1], counts[::-1], shards)
    out = np.zeros(len(sizes), np.int64)
    out[np.argsort(-np.array(sizes, np.int64), kind="stable")] = np.repeat(runs[:, 1], runs[:, 2])
    return out.tolist()


def _group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """``key, rows, shard`` of ``key, bytes, rows``."""
    spark = groups.sparkSession
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.desc("bytes")).toArrow()
    falling, counts = (sizes.column(c).to_numpy().astype(np.int64) for c in ("bytes", "n"))
    runs = pack_counts(falling, counts, shards)
    edge = np.searchsorted(runs[:, 0], np.arange(len(falling) + 1))
    taken = np.cumsum(runs[:, 2])
    ends = taken - np.repeat(np.cumsum(counts) - counts, np.diff(edge))  # groups of the size up to each run
    lists = lambda x: pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x))
    plan = pa.table({"bytes": pa.array(falling), "ends": lists(ends), "bins": lists(runs[:, 1].astype(np.int32))})
    by_size = spark.createDataFrame(plan)
    joined = groups.join(F.broadcast(by_size) if 4 * plan.nbytes < BROADCAST_BYTES else by_size, "bytes")
    alone = joined.where(F.size("ends") == 1).select("key", "rows", F.get("bins", F.lit(0)).alias("shard"))
    many = joined.where(F.size("ends") > 1).withColumn("run", F.pmod(F.xxhash64("key"), F.lit(RUNS)))
    before = F.sum("n").over(Window.partitionBy("bytes").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    counts = many.groupBy("bytes", "run").agg(F.count("*").alias("n")).select("bytes", "run", F.coalesce(before, F.lit(0)).alias("before"))
    many = many.withColumn("inside", F.row_number().over(Window.partitionBy("bytes", "run").orderBy("key"))).join(counts, ["bytes", "run"])
    rank = F.col("before") + F.col("inside")
    return alone.unionByName(many.select("key", "rows", F.get("bins", F.size(F.filter("ends", lambda e: e < rank))).alias("shard")))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is ``bytes``.

    Size is the text's UTF-8 bytes and one (null: one); the crc32 of a null text is that of an empty one. Equal texts
    share a shard, null texts are a group. Slots number a shard's rows from 0 without gaps, in an order by hash,
    id and text. Null ids are numbered as well, repeated rows get slots of their own. Very long texts count by their whole
    size. An empty table gives an empty one. Other columns are neither read nor returned.
    """
    if not 1 <= shards <= 1024:
        raise ValueError("1 to 1024 shards; pack larger tables part by part")
    text = F.col(text_col).cast("binary")
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("key"),
        )
    )
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    shard = cut(_group_shards(groups, shards))
    hot = maybe_broadcast(cut(shard.where(F.col("rows") >= HOT_ROWS).drop("rows")), BROADCAST_ROWS)
    cold = shard.where(F.col("rows") < HOT_ROWS).drop("rows")
    placed = rows.join(hot, "key").unionByName(rows.join(hot, "key", "left_anti").join(cold, "key"))
    placed = placed.withColumn("run", F.pmod(F.xxhash64(F.lit(1), "doc_id", "key"), F.lit(RUNS)).cast("int"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "run", F.coalesce(before, F.lit(0)).alias("before"))  # at most shards * RUNS rows
    inside = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "key"))
    numbered = placed.withColumn("inside", inside).join(F.broadcast(counts), ["shard", "run"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
