"""Source divergence audit: how far the term shares of a language's sources lie apart, and by which terms.

1.  Terms are counted by (language, source, term) with their documents; sums start in the task that reads the text.
2.  Each term that enough documents of its language hold becomes one wide row: an array of counts indexed by the language's sources.
3.  The counts turn into smoothed shares, and higher-order functions emit what every pair of sources differs by in that term: one
    row for each source with an array over the sources behind it. These are added up in the tasks that made them; only sums by pair are
    shuffled, as many for each task as the language has pairs.
4.  A source's most telling terms are the highest differences to its language; tasks keep their own highest before the shuffle.

All arithmetic is on integers. Every row is a term or a source of a language, never a document; the wide row of a term is as
long as its language has sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, blocks, cut, maybe_broadcast, utf8

#: Documents of a language that hold a term at least.
LEAST_DOCS = 10
#: Terms of a source that are reported.
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Sources (of all languages) up to which the tables of sources are broadcast.
BROADCAST_ROWS = 1 << 16
#: Bytes of text whose terms are counted at once.
BLOCK_BYTES = 8 << 20
#: The class [^\x00-\x40\x5B-\x60\x7B-\x7F] as bytes of UTF-8: letters A-Z and a-z, and all bytes of what lies beyond ASCII.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _edges(inside: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that no edge of a text cuts through."""
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edge[:-1][edge[:-1] < len(inside)]] = False
    after[edge[1:][edge[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``lang, source, text`` the counts of each block of texts; equal terms are told by their bytes, not by hashes."""
    for batch in batches:
        groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "source"])
        data, at = utf8(batch.column(2))
        for a, b in blocks(at, BLOCK_BYTES):
            own = groups.slice(a, b - a)
            rows = pa.RecordBatch.from_struct_array(own)
            keys = [c.dictionary_encode() for c in rows.columns]
            group = keys[0].indices.to_numpy().astype(np.int64) * len(keys[1].dictionary) + keys[1].indices.to_numpy()
            held = LOWER[data[at[a] : at[b]]]
            edge = at[a : b + 1] - at[a]
            inside = _IN_TERM[held]
            starts, ends = _edges(inside, edge)
            held = held[inside]
            offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
            text = np.searchsorted(edge[1:], starts, side="right")
            terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(held.tobytes())).dictionary_encode()
            code, width = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
            found, n = np.unique(group[text] * width + code, return_counts=True)
            once = np.unique(text * width + code)
            _, docs = np.unique(group[once // width] * width + once % width, return_counts=True)
            bare = np.setdiff1d(group, found // width)
            key = np.concatenate([found // width, bare])
            named = [x.dictionary.take(pa.array(i)) for x, i in zip(keys, np.divmod(key, len(keys[1].dictionary)), strict=True)]
            term = pa.concat_arrays([terms.dictionary.take(pa.array(found % width)).cast(pa.string()), pa.nulls(len(bare), pa.string())])
            zero = np.zeros(len(bare), np.int64)
            yield pa.RecordBatch.from_arrays([*named, term, pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([docs, zero]))], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n long, docs long``: occurrences and documents; a group without terms has one row of null term."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*named).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals: no count is too large."""
    wide = [x.cast("decimal(20,0)") for x in (count + 2, total + terms * 2)]
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide[0], wide[1]).cast("long") + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def wide_terms(counts: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(``lang, at, source, size``, the numbered sources of a language with the sum of their kept counts; ``lang, term, n``, kept terms and their counts by source)."""
    order = Window.partitionBy("lang").orderBy("source")
    sources = cut(counts.select("lang", "source").distinct().withColumn("at", F.row_number().over(order) - 1).withColumnsRenamed({"lang": "__lang", "source": "__source"}))
    here = (F.col("lang") == F.col("__lang")) & (F.col("source") == F.col("__source"))
    placed = counts.where("term IS NOT NULL").join(maybe_broadcast(sources, BROADCAST_ROWS), here)
    pivot = placed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("n")).where(F.col("docs") >= least)
    kept = cut(pivot.select("lang", "term", "n"))
    sizes = kept.select("lang", F.explode("n").alias("at", "n")).groupBy(F.col("lang").alias("l"), F.col("at").alias("a")).agg(F.sum("n").alias("size"))
    sized = sources.join(sizes, (F.col("__lang") == F.col("l")) & (F.col("at") == F.col("a")), "left")
    return sized.select(F.col("__lang").alias("lang"), "at", F.col("__source").alias("source"), F.coalesce("size", F.lit(0)).alias("size")), kept


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value long, rank int``: other sources (part ``pair``) by divergence, and telling terms (part ``term``).

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII. A language keeps the terms in at least ``least`` of its
    documents. A share is 1 + floor(10^9 * (count + 2) / (N + 2 * V)) over V kept terms with N occurrences; two shares differ by
    floor((p - q)^2 / (p + q)). A pair's value is the sum over all kept terms, and 0 without any. A term is reported for a source that has it
    at a share above the language's, only the ``top`` highest. Ranks count from 1, equal values by item in UTF-8 order.
    Null text, language and source read as empty; rows without terms still make their group occur; a source alone in its
    language has no pair. Repeated rows count each, very long texts by all their terms. An empty table gives an empty one; other
    columns are neither read nor returned.
    """
    sources, kept = wide_terms(cut(term_counts(docs)), least)
    sources = cut(sources)
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    listed = sources.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "source", "size"))).alias("s"), F.sum("size").alias("all"))
    few = maybe_broadcast(sources, BROADCAST_ROWS) is not sources  # then the table of languages, a row for each with all its sources, is small too
    langs = cut(listed.join(terms.withColumnRenamed("lang", "__l"), F.col("lang") == F.col("__l"), "left").select("lang", "s", "all", F.coalesce("v", F.lit(0)).alias("v")))
    hint = F.broadcast if few else lambda df: df

    wide = kept.join(hint(langs.withColumnRenamed("lang", "__lang")), F.col("lang") == F.col("__lang"))
    shares = F.transform("s", lambda s: share(F.coalesce(F.try_element_at("n", s["at"]), F.lit(0)), s["size"], F.col("v")))
    whole = share(F.aggregate(F.map_values("n"), F.lit(0).cast("long"), lambda a, b: a + b), F.col("all"), F.col("v"))
    wide = wide.select("lang", "term", "n", shares.alias("p"), whole.alias("q"))

    nothing = langs.select("lang", F.transform("s", lambda _: F.lit(1).cast("long")).alias("p"))  # a row that adds 0 to every pair
    firsts = wide.select("lang", "p").unionByName(nothing).select("lang", F.posexplode("p").alias("i", "x"), "p")
    behind = F.slice("p", F.col("i") + 2, F.size("p"))
    parts = firsts.select("lang", "i", F.posexplode(F.transform(behind, lambda y: difference(F.col("x"), y))).alias("k", "value"))
    pairs = parts.groupBy("lang", "i", "k").agg(F.sum("value").alias("value")).withColumn("j", F.col("i") + F.col("k") + 1)
    ends = F.explode(F.array(F.struct(F.col("i").alias("own"), F.col("j").alias("other")), F.struct(F.col("j").alias("own"), F.col("i").alias("other"))))
    pairs = cut(pairs.select("lang", "value", ends.alias("x")).select("lang", "value", "x.own", "x.other"))
    names = maybe_broadcast(sources.select(F.col("lang").alias("__l"), F.col("at").alias("__at"), F.col("source").alias("__name")), BROADCAST_ROWS)

    def named(df: DataFrame, at: str, name: str) -> DataFrame:
        return df.join(names, (F.col("lang") == F.col("__l")) & (F.col(at) == F.col("__at"))).withColumn(name, F.col("__name")).drop("__l", "__at", "__name")

    pairs = named(named(pairs, "own", "source"), "other", "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    telling = wide.select("lang", "term", "q", "p", F.explode(F.map_keys("n")).alias("at")).withColumn("x", F.get("p", F.col("at"))).where("x > q")
    telling = telling.select("lang", "at", F.col("term").alias("item"), difference(F.col("x"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.col("value").desc(), "item"))
    telling = named(telling.withColumn("rank", rank).where(F.col("rank") <= top), "at", "source")
    telling = telling.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(telling).withColumn("rank", F.col("rank").cast("int"))
