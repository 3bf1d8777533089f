"""Embedding whitening: compensated covariance of the distinct vectors, its leading components, and every row projected on them.

Entries become integers, so sums and means are exact. The covariance is centred first: an entry less the mean is an
unevaluated sum of two doubles. Blocks of centred rows are cut into slices of few bits without error (adding and taking away a large number), so
that products of slices add up exactly in a matrix product; those sums go into a total of high and low parts by error-free
two-sums. Tasks send their totals row of the matrix by row of the matrix; the parts of each row are merged in order of their tasks by the
same two-sums, in as many places as there are dimensions. The eigenvalues come from the tridiagonal form by divide and conquer (LAPACK's syevd, which
``numpy.linalg.eigh`` calls) on the driver, where only the d x d matrix is, and one step against the residual in extended precision
settles the vectors. The identity check repeats the same covariance over the whitened vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: What an entry is multiplied with before it is rounded down.
SCALE = 256
#: Components that are returned.
COMPONENTS = 4
#: Bits of a slice and slices of a number; 2 * SLICE_BITS + log2(BLOCK_ROWS) bits must fit a double's 53.
SLICE_BITS, SLICES = 20, 4
BLOCK_ROWS = 1 << 12
#: Entries must be smaller, so that a double holds them and their sums fit two longs.
LARGEST = 1 << 53
_LONG = 1 << 63
_SUM_BITS = 26


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """The lists of an Arrow column, equally long and without nulls, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and what rounding lost, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(high + low) + (x + y) as high and low parts."""
    s, e = two_sum(high, x)
    t, f = two_sum(low, y)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def sliced(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """``SLICES`` matrices of SLICE_BITS bits by column, each slice an exact part of what the ones before left."""
    out = []
    most = np.abs(high).max(axis=0)
    top = np.where(most > 0, np.ceil(np.log2(np.maximum(most, 5e-324))) + 1, 0)
    for k in range(1, SLICES + 1):
        pull = np.ldexp(1.5, (top - k * SLICE_BITS + 52).astype(int))
        part = (high + pull) - pull
        out.append(part)
        high, low = two_sum(high - part, low)
    return out


def outer_sum(high: np.ndarray, low: np.ndarray, total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``total`` and the sum of the outer products of the rows high + low."""
    parts = sliced(high, low)
    for i in range(SLICES):
        for j in range(SLICES - i):
            total = add(*total, parts[i].T @ parts[j], np.zeros(1))
    return total


def _totals(centred):
    """Rows (place, task, high, low) of the covariance sum over all that a task reads; ``centred`` turns a batch into both parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for a in range(0, len(batch), BLOCK_ROWS):
                high, low = centred(batch.slice(a, BLOCK_ROWS))
                if total is None:
                    total = np.zeros((2, high.shape[1], high.shape[1]))
                total = outer_sum(high, low, tuple(total))
        if total is not None:
            d = len(total[0])
            task = np.full(d, TaskContext.get().partitionId(), np.int32)
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in total]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(task), *lists], names=["place", "task", "high", "low"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by place and task, one for each place."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for place, high, low in zip(batch.column(0).to_pylist(), matrix(batch.column(2), float), matrix(batch.column(3), float), strict=True):
            held[place] = add(*held[place], high, low) if place in held else (high, low)
    if held:
        lists = [pa.array([x[i] for x in held.values()], pa.list_(pa.float64())) for i in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *lists], names=["place", "high", "low"])


def covariance(rows: DataFrame, centred, d: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the sum of outer products of the centred rows: d rows of d entries come to the driver."""
    parts = rows.mapInArrow(_totals(centred), "place int, task int, high array<double>, low array<double>")
    merged = parts.repartition("place").sortWithinPartitions("place", "task").mapInArrow(_merged, "place int, high array<double>, low array<double>")
    total = np.zeros((2, d, d))
    for place, high, low in merged.collect():
        total[:, place] = high, low
    return total[0], total[1]


def components(high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the symmetric matrix high + low, falling, and their unit vectors as columns, largest entry positive."""
    _, v = np.linalg.eigh(high)
    a, w = high.astype(np.longdouble) + low, v.astype(np.longdouble)
    for _ in range(2):
        lost = np.eye(len(w)) - w.T @ w
        t = w.T @ a @ w
        values = np.diag(t) / (1 - np.diag(lost))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 1e-10 * np.abs(values).max()  # of equal values any basis will do
        turn = np.where(near, lost / 2, (t + values[None, :] * lost) / np.where(near, 1, gap))
        w = w + w @ turn
        w = w + w @ (np.eye(len(w)) - w.T @ w) / 2  # unit length and right angles again
    w = w / np.sqrt((w * w).sum(axis=0))
    order = np.argsort(-values, kind="stable")[:k]
    w = w[:, order]
    w = w * np.where(w[np.abs(w).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
    return values[order].astype(float), w.astype(float)


def usable(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose list is not empty and holds finite numbers below LARGEST / SCALE only, with ``x`` = floor(SCALE * entry) + 0."""
    finite = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < float(LARGEST), F.lit(False)))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(0).cast("long"))
    return rows.where(F.col(column).isNotNull() & (F.size(column) > 0) & finite).withColumn("x", x)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        x = matrix(batch.column(0), np.int64)
        halves = np.stack([(x >> _SUM_BITS).sum(axis=0), (x & ((1 << _SUM_BITS) - 1)).sum(axis=0)])
        n, total = n + len(x), halves if total is None else total + halves
    if n:
        place = pa.array(np.arange(total.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([place, pa.array(np.full(total.shape[1], n)), *map(pa.array, total)], names=["place", "n", "upper", "lower"])


def _deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * x - s)^2, exactly; null where a long can't hold it."""
    rough = n * x.astype(float) - np.array(s, float)
    small = (rough * rough).sum(axis=1) < _LONG / 2
    inside = np.abs(x).max(axis=1, initial=0) < _LONG // 2 // max(n, 1)
    out: list[int | None] = [None] * len(x)
    fast = np.flatnonzero(small & inside & (max(map(abs, s), default=0) < _LONG // 2))
    diff = n * x[fast] - np.array([v if abs(v) < _LONG else 0 for v in s], np.int64)
    for i, v in zip(fast.tolist(), (diff * diff).sum(axis=1).tolist(), strict=True):
        out[i] = v
    for i in np.setdiff1d(np.flatnonzero((rough * rough).sum(axis=1) < 2.0 * _LONG), fast).tolist():
        v = sum((n * a - b) ** 2 for a, b in zip(x[i].tolist(), s, strict=True))
        out[i] = v if v < _LONG else None
    return out


def whiten(rows: DataFrame, id_col: str = "vec_id", column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``vec_id, component int, n long, deviation long, whitened double, explained double, identity_error double`` of every row and component up to k.

    Null vectors and vectors with a null or non-finite entry take no part; nor do empty ones, those with an entry of 2^45 or more, and those of
    another length than most rows have (of equally frequent lengths the longer). Equal vectors count once in the fit list, and every
    row of them is returned, as are rows of a null or repeated id. Where a component has no variance (fewer different vectors than components,
    constant dimensions), ``whitened`` is null, ``explained`` 0, and it is left out of ``identity_error``; with no variance at all ``explained`` and
    ``identity_error`` are null. ``deviation`` is null where it is beyond a long. With fewer than k dimensions there are as many components as
    dimensions. An empty table, or one without any usable vector, gives an empty one. Other columns are neither read nor returned.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = usable(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("v")), "v").select("vec_id", "x")
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows"))
    most = lengths.orderBy(F.col("rows").desc(), F.col("d").desc()).limit(1).collect()
    if not most:
        return spark.createDataFrame([], schema)
    d = most[0]["d"]
    vectors = vectors.where(F.size("x") == d)
    fit = cut(vectors.select("x").distinct())
    sums = fit.mapInArrow(_sums, "place int, n long, upper long, lower long").groupBy("place")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "upper", "lower")]
    found = sorted(sums.agg(*wide).collect())  # a row for each dimension
    n, s = int(found[0]["n"]), [(int(r["upper"]) << _SUM_BITS) + int(r["lower"]) for r in found]
    mean = np.array([v / n for v in s])
    rest = np.array([float(Fraction(v, n) - Fraction(m)) for v, m in zip(s, mean.tolist(), strict=True)])

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        high, low = two_sum(matrix(batch.column(0), float), -mean)
        return two_sum(high, low - rest)

    high, low = covariance(fit, centred, d)
    values, axes = components(high / n, (low - (high - high / n * n)) / n, min(k, d))
    trace = float(np.trace(high) + np.trace(low)) / n
    real = values > 64 * d * np.finfo(float).eps * trace
    scaled = axes[:, real] / np.sqrt(values[real])

    def whitened(batch: pa.RecordBatch) -> np.ndarray:
        high, low = centred(batch)
        return high @ scaled + low @ scaled

    error = None
    if real.any():
        wh, wl = covariance(fit, lambda batch: (whitened(batch), np.zeros((len(batch), int(real.sum())))), int(real.sum()))
        error = float(np.abs((wh + wl) / n - np.eye(len(wh))).max())
    explained = [float(max(v, 0.0) / trace) if r else 0.0 for v, r in zip(values, real, strict=True)] if trace > 0 else [None] * len(values)
    number, at = len(values), np.cumsum(real) - 1

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.select([1])
            w = whitened(x)
            columns = [pa.array(w[:, at[i]] if real[i] else [None] * len(batch), pa.float64()) for i in range(number)]
            row = np.repeat(np.arange(len(batch)), number)
            order = (np.arange(len(row)) % number) * len(batch) + row
            deviation = pa.array(_deviations(matrix(batch.column(1), np.int64), n, s), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)), pa.array((np.arange(len(row)) % number + 1).astype(np.int32)), pa.array(np.full(len(row), n)),
                    deviation.take(pa.array(row)), pa.concat_arrays(columns).take(pa.array(order)), pa.array(explained * len(batch), pa.float64()), pa.array([error] * len(row), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(projected, schema)
