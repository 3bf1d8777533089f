"""Benchmark decontamination: short test items found inside long documents by size-partitioned MinHash containment.

An item of n distinct shingles counts as contained when a document holds at least ceil(threshold * n) of them. Items are
put into partitions by size (powers of two). Each partition has its own sketch length, 1 + the most shingles that a
contained item of that size may miss; an item's sketch is that many of its shingles with the smallest hashes. Any
document that contains the item holds one of them at least, so the search loses nothing; what it finds is verified by
counting the exact shingles in common. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, maybe_broadcast

#: Rows of item shingles (24 bytes each) up to which they are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1 << 20


def word_array(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits of any script."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingle_array(words: Column, width: int) -> Column:
    """Distinct hashed shingles; the words are bound to a lambda's name, else every use would compute them anew."""

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    every = F.transform(F.array(words), lambda w: F.when(F.size(w) >= width, F.array_distinct(hashed(w))).otherwise(F.array().cast("array<bigint>")))
    return F.get(every, F.lit(0))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, n_item, n_common, containment`` for every document and item contained in it.

    Words are lower-cased runs of letters and digits; an item of fewer than ``width`` words, null or empty has no
    shingle and is never found, nor is it in a null, empty or short text. Equal texts or items give the same rows
    for each distinct id; repeated rows of an id count once, with the shingles of all its texts. Rows with a null id
    are not reported. Other columns are not read.
    """
    item = items.select(F.col(item_col).alias("item_id"), F.explode(_shingle_array(word_array(F.col(text_col)), width)).alias("h"))
    item = item.where("item_id IS NOT NULL").distinct()
    size = item.groupBy("item_id").agg(F.count("*").alias("n_item"))
    size = size.withColumn("part", F.floor(F.log2("n_item")).cast("int"))
    largest = F.pow(F.lit(2), F.col("part") + 1) - 1
    item = cut(
        item.join(size, "item_id")
        .withColumn("sketch", (largest - F.ceil(largest * F.lit(threshold)) + 1).cast("int"))
        .withColumn("rank", F.expr("row_number() OVER (PARTITION BY item_id ORDER BY h)"))
        .select("item_id", "n_item", "part", "h", (F.col("rank") <= F.col("sketch")).alias("in_sketch"))
    )
    sketch = maybe_broadcast(cut(item.where("in_sketch").select("h").distinct()), BROADCAST_ROWS)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")).where("doc_id IS NOT NULL")
    shingle = _shingle_array(word_array(F.col("__text")), width)
    hit = texts.select("doc_id", F.explode(shingle).alias("h")).join(sketch, "h", "left_semi").select("doc_id", "h").distinct()
    ids = cut(hit.join(item.where("in_sketch").select("h", "item_id"), "h").select("doc_id", "item_id").distinct())

    wanted = maybe_broadcast(cut(ids.select("doc_id").distinct()), BROADCAST_ROWS)
    whole = texts.join(wanted, "doc_id", "left_semi").select("doc_id", F.explode(shingle).alias("h"))
    every = maybe_broadcast(cut(item.select("h").distinct()), BROADCAST_ROWS)
    common = whole.join(every, "h", "left_semi").distinct().join(item.select("h", "item_id", "n_item"), "h")
    common = common.join(ids, ["doc_id", "item_id"], "left_semi")
    found = common.groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_common"))
    found = found.where(F.col("n_common") >= F.ceil(F.col("n_item") * F.lit(threshold)))
    return found.select("doc_id", "item_id", F.col("n_item").cast("long"), "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no item; see contained_items.

    Texts are searched, not ids: rows are keyed by the md5 of their text, so a null or repeated doc_id hides nothing
    and equal texts fare alike. Items with a null id are searched as well, keyed by their own text. Rows with a null
    or empty text stay; an empty table of either kind takes nothing away.
    """
    key = F.md5(F.col("text").cast("binary"))
    asked = items.where("text IS NOT NULL").select(key.alias("item_id"), "text").distinct()
    found = cut(contained_items(docs.select(key.alias("doc_id"), "text"), asked).select(F.col("doc_id").alias("__leaked")).distinct())
    return docs.join(maybe_broadcast(found, BROADCAST_ROWS), key == F.col("__leaked"), "left_anti")
