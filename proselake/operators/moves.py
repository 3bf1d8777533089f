"""Sentences that a rewrite moved to another paragraph: a similarity join inside each text.

A sentence counts by its letters and digits alone. Those that stayed, or stand elsewhere, word for word are settled by one grouping. The others
meet the other version's sentences of their text, whole and in blocks, as a stream of pairs that is never kept: most pairs go by
paragraphs or lengths, the rest have their edit distance computed inside its bound alone. (Short pieces of prose are so frequent that a join by pieces
makes more rows than there are pairs of sentences.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Letters of the shortest sentence, and how like sentences count as kept in their paragraph or found in another, in percent.
SHORTEST = 6
KEPT, FOUND = 72, 82
#: Units of one key and side that meet another side's in one group, about.
BLOCK = 1000


def _bare(text: Column) -> Column:
    """Sentences of SHORTEST letters or more, by letters, digits and Han characters alone."""
    bare = lambda s: F.regexp_replace(F.lower(s), r"[^\x{4e00}-\x{9fff}a-z0-9]", "")
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^\n。！？!?]+"), F.lit(0)), bare), lambda u: F.length(u) >= SHORTEST)


def sentence_units(texts: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """``keys, unit, para, there``: the one paragraph of the old text that has a sentence (null: none or several), and all of the new one, each once."""
    paras = lambda c, new: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n+", -1), lambda text, i: F.struct(F.lit(new).alias("new"), i.alias("para"), text.alias("text")))
    each = texts.select(*keys, F.explode(F.concat(paras(before, False), paras(after, True))).alias("p"))
    each = each.select(*keys, "p.new", "p.para", F.explode(_bare(F.col("p.text"))).alias("unit"))
    own = F.when(~F.col("new"), F.col("para"))
    one = F.when(F.min(own) == F.max(own), F.min(own))
    return each.groupBy(*keys, "unit").agg(one.alias("para"), F.collect_set(F.when(F.col("new"), F.col("para"))).alias("there"))


def _same(columns: list[str]) -> Column:
    """``columns`` of the left side equal those of the right, which have two underscores before their names."""
    return reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in columns])


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"__{c}" for c in df.columns})


def _edits(a: Column, b: Column, least: Column) -> Column:
    """The edit distance of two units alike by ``least`` percent; -1 of others, of which only what the bound allows is computed."""
    longer = F.greatest(F.length(a), F.length(b))
    fits = F.least(F.length(a), F.length(b)) * 100 >= longer * least
    return F.when(fits, F.call_function("levenshtein", a, b, F.floor(longer * (100 - least) / 100).cast("int"))).otherwise(-1)


def _holds(a: Column, b: Column) -> Column:
    return F.when(F.length(a) > F.length(b), F.contains(a, b)).otherwise(F.contains(b, a))


def _meeting(left: DataFrame, right: DataFrame, keys: list[str], wanted: Column, how: str = "inner") -> DataFrame:
    """The join of units by keys as far as they are wanted; both sides carry ``n_left`` and ``n_right``, how many units of their key stand on either.

    The units of a key are dealt to blocks of about BLOCK by hash, and every block of one side meets every block of the other: a group
    has about BLOCK units of either side, however long a text is.
    """
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("unit"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = left.select("*", own("n_left").alias("p"), every("n_right").alias("q")).drop("n_left", "n_right")
    right = right.select("*", every("n_left").alias("p"), own("n_right").alias("q")).drop("n_left", "n_right")
    return left.join(_marked(right).hint("merge"), _same([*keys, "p", "q"]) & wanted, how)  # pairs are many: no side is broadcast


def alike_pairs(left: DataFrame, right: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``keys, unit, __unit`` of units of both sides with equal keys whose edit distance is at most (100 - least) percent of the longer.

    Each side has a unit of a key once.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("n_left")).join(right.groupBy(*keys).agg(F.count("*").alias("n_right")), keys)
    met = _meeting(left.join(counts, keys), right.join(counts, keys), keys, _edits(F.col("unit"), F.col("__unit"), F.lit(least)) >= 0)
    return met.select(*keys, "unit", "__unit")


def moved_sentences(pairs: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """``keys, para, unit`` of sentences that one paragraph alone had, that it lost, and that another paragraph now has.

    Lost: no sentence of the paragraph of the same number is alike by KEPT percent. Found: a sentence of another paragraph is alike by FOUND
    percent, holds it or is held by it. Alike is 100 less the edit distance as a share of the longer. Null and empty texts have no sentences;
    repeated sentences of one paragraph count once. Keys name a pair of texts and are not null.
    """
    gone, stands = F.col("para").isNotNull() & ~F.array_contains("there", F.col("para")), F.size("there") > 0
    whole = Window.partitionBy(*keys)
    units = sentence_units(pairs, keys, before, after).withColumns({"n_left": F.count_if(gone).over(whole), "n_right": F.count_if(stands).over(whole)})
    lost = units.where(gone & (F.col("n_right") > 0)).withColumn("stands", stands).drop("there")
    there = units.where(stands & (F.col("n_left") > 0)).drop("para")
    a, b, para = F.col("unit"), F.col("__unit"), F.col("para")
    here = F.array_contains("__there", para)
    other = F.size("__there") > F.when(here, 1).otherwise(0)
    open_ = ~F.col("stands") & other  # not known yet to be found
    edits = _edits(a, b, F.when(here, F.lit(KEPT)).otherwise(F.lit(FOUND)))
    met = _meeting(lost, there, keys, (here | open_) & ((open_ & _holds(a, b)) | (edits >= 0)), "left")
    near = (edits >= 0) & (edits * 100 <= F.greatest(F.length(a), F.length(b)) * (100 - FOUND))
    flags = met.select(*keys, "para", "unit", (F.col("stands") | (other & (_holds(a, b) | near))).alias("found"), (here & (edits >= 0)).alias("kept"))
    told = flags.groupBy(*keys, "para", "unit").agg(F.bool_or("found").alias("found"), F.bool_or("kept").alias("kept"))
    return told.where("found AND NOT coalesce(kept, false)").select(*keys, "para", "unit")
