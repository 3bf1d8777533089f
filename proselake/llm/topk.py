"""Exact top-k by inner product: columnar branch and bound over dimension blocks.

Every query first meets one sample of vectors of bounded size: its k-th best score there is a floor that no result is below.
Then vectors and queries are dealt into blocks of bounded size, and every query block meets every vector block in a task of
its own. There, vectors lie column by column. Scores are accumulated for a few dimensions at a time, those with most
mass in the queries first; by Cauchy and Schwarz the rest of a score is at most the product of the remaining norms.
A vector whose best score stays below the floor or the k-th best of the sure scores goes, and the others are compacted. Each
block's best are merged by query. The integers are summed exactly: in floating point only where every partial sum is
proven to fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Vectors and queries of a block: each vector is sent once for each query block, each query once for each vector block.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 16_384
#: Bytes of the vectors that all queries meet first.
SAMPLE_BYTES = 4 << 20
#: Queries whose first scores are computed at once.
OPENING = 256
DIMENSIONS = 8


def integers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long; null if any component is null or not finite."""
    held = vector.cast("array<double>")
    finite = F.forall(held, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(held, lambda x: F.floor(x * scale)))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: list[int | None] | None = None) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best, none below its floor; ties to smaller ids, no vector of the query's own id."""
    n, d = vectors.shape
    exact = d == 0 or float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * d < 2**53
    kind = np.float64 if exact else np.int64
    order = np.argsort(-(queries.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(vectors[:, order].T.astype(kind))
    queries = queries[:, order].astype(kind)
    starts = list(range(0, d, DIMENSIONS)) or [0]

    def rest(x: np.ndarray) -> np.ndarray:
        """Norms of what follows each block, a row for each; a little too long rather than too short."""
        square = x.astype(np.float64) ** 2
        return np.stack([np.sqrt(square[s + DIMENSIONS :].sum(axis=0)) * (1 + 1e-9) for s in starts])

    far, far_query = rest(columns), rest(queries.T)
    out = []
    for q in range(len(queries)):
        if q % OPENING == 0 and exact:
            opening = queries[q : q + OPENING, :DIMENSIONS] @ columns[:DIMENSIONS]
        live = np.flatnonzero(ids != query_ids[q])
        score = opening[q % OPENING, live] if exact else columns[:DIMENSIONS, live].T @ queries[q, :DIMENSIONS]
        floor = floors[q] if floors is not None else None
        for b, s in enumerate(starts):
            if b:
                score = score + queries[q, s : s + DIMENSIONS] @ columns[s : s + DIMENSIONS, live]
            if len(live) > k or floor is not None:
                slack = far[b, live] * far_query[b, q]
                keep = score + slack >= floor if floor is not None else np.ones(len(live), bool)
                if len(live) > k and (floor is None or keep.sum() > k):
                    sure = score - slack
                    keep &= score + slack >= np.partition(sure, len(sure) - k)[len(sure) - k]
                live, score = live[keep], score[keep]
        best = np.lexsort((ids[live], -score))[:k]
        out += zip([int(query_ids[q])] * len(best), ids[live[best]].tolist(), [int(x) for x in score[best]], strict=True)
    return out


def _read(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of rows of one dimension."""
    lists = t.column("v")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    d = len(lists.flatten()) // max(1, len(t))
    return t.column("id").to_numpy(), lists.flatten().to_numpy().reshape(len(t), d)


def _meet(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = search(*_read(left), *_read(right), k, right.column("floor").to_pylist()) if len(left) and len(right) else []
        a, b, c = np.array(rows, dtype=np.int64).reshape(-1, 3).T
        return pa.table({"query_id": pa.array(a), "vec_id": pa.array(b), "score": pa.array(c)})

    return run


def _floors(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds each query's k-th best score among the sample's vectors of its dimension, null if they are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, floor = batch.column(2).to_numpy(), np.full(len(batch), None, object)
            for own in np.unique(d):
                at = np.flatnonzero(d == own)
                if own in sample and len(sample[own][0]) > k:
                    ids, vectors = _read(batch.take(pa.array(at)))
                    best = search(*sample[own], ids, vectors, k)
                    floor[at] = [x[2] for x in best[k - 1 :: k]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor.tolist(), pa.int64())], names=["id", "v", "d", "floor"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k vectors of highest inner product, ties to smaller ids.

    Components are taken as floor(scale * x). Vectors and queries that are null or hold null or non-finite components
    take no part, nor do null ids; a query meets vectors of its own dimension only and none of its own id. Repeated
    rows of an id count once if equal. Fewer than k vectors give fewer rows. Other columns are not read.
    """
    def clean(df: DataFrame) -> DataFrame:
        held = df.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"))
        return held.where("id IS NOT NULL AND v IS NOT NULL").dropDuplicates(["id", "v"]).withColumn("d", F.size("v"))

    db, asked = cut(clean(vectors)), cut(clean(queries))
    widest = max(1, db.agg(F.max("d")).first()[0] or 1)
    few = db.orderBy(F.xxhash64("id"), "id", "v").limit(min(VECTOR_BLOCK, max(k + 1, SAMPLE_BYTES // (8 * widest)))).toArrow()
    sample = {d: _read(few.filter(pc.field("d") == d)) for d in few.column("d").unique().to_pylist()}
    asked = cut(asked.mapInArrow(_floors(sample, k), "id long, v array<bigint>, d int, floor long"))
    n, m = (max(1, -(-df.count() // size)) for df, size in ((db, VECTOR_BLOCK), (asked, QUERY_BLOCK)))
    m = max(m, -(-db.sparkSession.sparkContext.defaultParallelism // n))  # no fewer tasks than cores
    of = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = db.withColumn("a", of(n)).withColumn("b", every(m)).groupBy("d", "a", "b")
    right = asked.withColumn("b", of(m)).withColumn("a", every(n)).groupBy("d", "a", "b")
    near = left.cogroup(right).applyInArrow(_meet(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
