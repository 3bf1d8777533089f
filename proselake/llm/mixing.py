"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source's target comes from its weight, up to a multiple of its size. A document is expected expected = target /
source size times: that many whole copies are certain, and the fraction is the probability of one more. These are
drawn by Pareto order sampling: documents are ranked by the odds of a uniform number over the odds of inclusion, and
the lowest ranks are taken until the source's target is met. The uniform number is a hash of the row and the seed, so
reruns agree. The cut in the ranking is found from a histogram of ranks by source; only the histogram's one bin that
holds the cut is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, maybe_broadcast

#: Rank bins of a source; the one with the cut is sorted as a whole.
BINS = 4096
#: Sources up to which their table is broadcast.
BROADCAST_ROWS = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(seed: int) -> Column:
    """A number in (0, 1) that depends on the row's id, source and text alone."""
    bits = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))
    return (F.shiftrightunsigned(bits, 12).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` of ``source, source_size``.

    Weights repeat over the sources in code point order, null last. A target is level * weight or ``most`` times
    the source's size if that is less, with the one level that spends share * all sizes: what stays when excess over
    a limit is reshared until none is above.
    """
    everything = Window.partitionBy()
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    t = sizes.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(order, F.lit(len(weights)))))
    t = t.withColumn("limit", F.col("source_size") * float(most)).withColumn("ratio", F.col("limit") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    t = t.withColumn("spent", F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(everything) * float(share) - F.coalesce("spent", F.lit(0.0))) / F.col("left"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return t.select("source", "source_size", F.coalesce(F.least("limit", level * F.col("w")), "limit").alias("target"))


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """For each source ``source_size, target, certain, part`` and the last rank taken, of ``source, size, draw``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, most)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("certain", F.floor(expected)).withColumn("part", expected - F.col("certain"))
    plan = plan.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    plan = cut(plan.withColumnRenamed("source", "__source"))

    joined = rows.join(maybe_broadcast(plan, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("__source")))
    ranked = joined.where("rest > 0 AND size > 0").select("__source", "size", "rest", pareto_rank(F.col("draw"), F.col("part")).alias("rank"))
    ranked = ranked.withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BINS), F.lit(BINS - 1)))
    bins = ranked.groupBy("__source", "bin", "rest").agg(F.sum("size").alias("size"))
    up_to = Window.partitionBy("__source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("size").over(up_to), F.lit(0)))
    last = bins.where("before < rest").groupBy("__source").agg(F.max(F.struct("bin", "before")).alias("x"))
    last = cut(last.select(F.col("__source").alias("__s"), F.col("x.bin").alias("__bin"), F.col("x.before").alias("before")))
    inside = ranked.join(maybe_broadcast(last, BROADCAST_ROWS), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("bin") == F.col("__bin")))
    near = Window.partitionBy("__source").orderBy("rank")
    inside = inside.withColumn("middle", F.col("before") + F.sum("size").over(near.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2)
    fits = F.col("middle") <= F.col("rest")
    tied = inside.groupBy(F.col("__source").alias("__e"), "rank").agg(F.count("*").alias("end_rows"), F.count_if(fits).alias("end_taken")).where("end_taken > 0")
    ends = tied.groupBy("__e").agg(F.max(F.struct("rank", "end_rows", "end_taken")).alias("x")).select("__e", F.col("x.rank").alias("end"), "x.end_rows", "x.end_taken")
    plan = plan.join(last, F.col("__source").eqNullSafe(F.col("__s")), "left").join(ends, F.col("__source").eqNullSafe(F.col("__e")), "left")
    floor = F.when(F.col("__bin").isNull(), F.lit(-1.0)).otherwise(F.col("__bin") / (BINS - F.col("__bin")))
    return cut(plan.select("__source", "source_size", "target", "certain", "part", "end", "end_rows", "end_taken", floor.alias("below")))


def pareto_rank(draw: Column, part: Column) -> Column:
    """Random odds over inclusion odds; null if inclusion is impossible."""
    return F.when(part > 0, (draw / (1 - draw)) * F.try_divide(1 - part, part))


def _with_copies(joined: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows joined to their source's plan, with whole ``copies``; ranks of lower bins are all taken.

    Rows that equal each other in id, source and text share a rank. Where the cut falls into such a block, as many of its rows
    are taken as fit, counted part by part; the rows of the block are alike, so it doesn't matter which.
    """
    rank = pareto_rank(F.col("draw"), F.col("part"))
    drawn = F.coalesce((F.col("part") > 0) & (F.col("size") > 0), F.lit(False))
    joined = joined.withColumn("__more", drawn & F.coalesce((rank < F.col("below")) | (rank <= F.col("end")), F.lit(False)))
    copies = (F.col("certain") + F.col("__more").cast("int")).cast("long")
    if not plan.where("end_taken < end_rows").limit(1).count():
        return joined.withColumn("copies", copies)
    split = F.col("__more") & F.coalesce((rank == F.col("end")) & (F.col("end_taken") < F.col("end_rows")), F.lit(False))
    edge = cut(joined.where(split)).withColumn("__at", F.spark_partition_id())
    up_to = Window.partitionBy("__source").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = edge.groupBy("__source", "__at").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(up_to), F.lit(0))).drop("n")
    before = before.withColumnsRenamed({"__source": "__s", "__at": "__a"})
    own = F.row_number().over(Window.partitionBy("__source", "__at").orderBy(F.monotonically_increasing_id()))
    edge = edge.withColumn("__n", own).join(before, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__at") == F.col("__a")))
    edge = edge.withColumn("__more", F.col("__n") + F.col("__before") <= F.col("end_taken")).select(*joined.columns)
    every = joined.where(~split).unionByName(edge)
    return every.withColumn("copies", copies)


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row of documents.

    Sizes are words (null and empty texts: 0, with no copies beyond the certain ones). Null sources are one source,
    the last. Rows that equal each other in id, source and text share their draw; of a block of them at the cut as many are
    taken as fit. An empty table gives an empty one, very long texts count by all their words. Other columns are neither read nor returned.
    """
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draw(seed).alias("draw")))
    plan = _plan(rows, weights, share, most)
    joined = _with_copies(rows.join(maybe_broadcast(plan, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("__source"))), plan)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it; see mix_documents."""
    columns = docs.columns
    own = [F.col(c).alias(f"__in_{i}") for i, c in enumerate(columns)]
    size, draw = word_count(F.col("text")), _draw(seed)
    rows = cut(docs.select("source", size.alias("size"), draw.alias("draw")))
    plan = _plan(rows, weights, share, most)
    full = docs.select(*own, F.col("source").alias("__own_source"), size.alias("size"), draw.alias("draw"))
    joined = _with_copies(full.join(maybe_broadcast(plan, BROADCAST_ROWS), F.col("__own_source").eqNullSafe(F.col("__source"))), plan).where("copies > 0")
    again = joined.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(columns)])
