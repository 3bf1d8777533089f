"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


#: Edges that one task contracts on average (16 bytes each).
TASK_EDGES = 250_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A union-find over what one task holds: (node, smallest node of its part); never more rows than came in."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(x, root(x)) for x in parent]
    out = [(x, r) for x, r in out if x != r]
    if out:
        u, v = np.array(out, dtype=np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``node long, component long`` (the smallest node reachable) for every node of ``u long, v long``.

    First every task contracts the edges it holds, TASK_EDGES of them on average; if one task held all, that is the
    result. Else rounds join every node's neighbours to the smallest of them (large star, then small star) until
    nothing changes; hubs are never gathered, they are joined. Nulls take no part,
    loops and repeated edges change nothing, an empty table gives an empty one.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v")
    e = cut(e)
    tasks = -(-e.count() // TASK_EDGES) or 1
    e = cut(e.coalesce(tasks).mapInArrow(_local_stars, "u long, v long"))
    last = None
    while tasks > 1:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(floor.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
