"""Edits as data: which of a text's edits are made is decided over sorted arrays, texts are put together from pieces, and places follow.

An edit is ``start, end, new, rule`` (characters of the old text, end not included). Rules find edits, filters drop some (a budget, terms that would be
lost), a fold keeps those that don't overlap, and only then texts change; whatever points into a text can follow it to the new one.
All of it works inside a text's row: nothing but a text's own edits and findings is ever gathered. What walks along a text (places of matches,
overlaps, putting together, following) is an Arrow pass, since columns would copy what they have so far at each step; time follows text and edits.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("matched", T.StringType())]))
_EDIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("new", T.StringType()), T.StructField("rule", T.StringType())])
EDIT = "struct<start:int,end:int,new:string,rule:string>"


def _once(x: Column, f) -> Column:
    """``f(x)`` that computes ``x`` once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), 0)


def found_edits(text: Column, pattern: str, new: str, rule: str) -> Column:
    """Edits of every match of a pattern that is not empty, by place; ``new`` may name the pattern's groups.

    A match is rewritten by itself, so a pattern must not look at what is around it, and must mean the same to Python and Spark.
    """
    own = re.compile(pattern)

    @_pass(_SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        found = [None if t is None else [(*m.span(), m.group()) for m in own.finditer(t) if m.group()] for t in texts.to_pylist()]
        return X._lists(found, X._SPAN)

    found = spans(text)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.regexp_replace(x["matched"], pattern, new).alias("new"), F.lit(rule).alias("rule")).cast(EDIT))


def _pass(kind: T.DataType):
    """An Arrow function whose column is computed once, where it is named: the optimizer would copy it into what reads it, where it cannot run."""
    return lambda work: F.arrow_udf(work, kind).asNondeterministic()


def _rows(edits: pa.Array, *names: str):
    """For each row the lists of these fields of its edits, None for null."""
    flat, sizes = edits.flatten(), edits.value_lengths().to_pylist()
    fields, at = [flat.field(n).to_pylist() for n in names], 0
    for n in sizes:
        yield None if n is None else [f[at : at + n] for f in fields]
        at += n or 0


def _only(edits: pa.Array, kept: list[list[bool] | None]) -> pa.Array:
    """The edits that are marked as kept."""
    at = np.concatenate(([0], np.cumsum([sum(k or ()) for k in kept]))).astype(np.int32)
    flat = edits.flatten().filter(pa.array([x for k in kept for x in k or ()], pa.bool_()))
    return pa.ListArray.from_arrays(pa.array(at), flat, mask=pa.array([k is None for k in kept], pa.bool_()))


@_pass(T.ArrayType(_EDIT))
def _without_overlaps(edits: pa.Array) -> pa.Array:
    kept = []
    for row in _rows(edits, "start", "end"):
        last, own = 0, []
        for start, end in zip(*row or ((), ()), strict=True):
            own.append(start >= last)
            last = max(last, end) if start >= last else last
        kept.append(None if row is None else own)
    return _only(edits, kept)


def _exempt(rules: list[str], budget: int) -> set[str]:
    """Which of the rules of low edits the budget lets stand."""
    hit = sorted((n, r) for r, n in Counter(rules).items())
    if len(rules) <= budget:
        return {r for _, r in hit}
    left, out = len(rules), set()
    for n, r in hit:
        if left - n < budget:
            break
        left -= n
        out.add(r)
    return out


@_pass(T.ArrayType(T.StringType()))
def _taken(texts: pa.Array, edits: pa.Array) -> pa.Array:
    """What stands where each edit is."""
    rows = zip(texts, _rows(edits, "start", "end"), strict=True)
    return pa.array([None if row is None or not t.is_valid else [own[a:b] for own in (t.as_py(),) for a, b in zip(*row, strict=True)] for t, row in rows], pa.list_(pa.string()))


@_pass(T.StringType())
def _put_together(texts: pa.Array, edits: pa.Array) -> pa.Array:
    """Each text with what its edits put there."""
    out = []
    for t, row in zip(texts, _rows(edits, "start", "end", "new"), strict=True):
        own = None if row is None else t.as_py()
        if own is not None and row[0]:
            parts, at = [], 0
            for start, end, new in zip(*row, strict=True):
                parts += [own[at:start], new]
                at = end
            own = "".join([*parts, own[at:]])
        out.append(own)
    return pa.array(out, pa.string())


@_pass(T.ArrayType(T.IntegerType()))
def _shifts(starts: pa.Array, ends: pa.Array, edit_starts: pa.Array, edit_ends: pa.Array, grown: pa.Array) -> pa.Array:
    """By how much each span moves; null where an edit touches it. Edits are sorted and don't overlap."""
    out = []
    for a, b, x, y, more in zip(*(c.to_pylist() for c in (starts, ends, edit_starts, edit_ends, grown)), strict=True):
        total = np.concatenate(([0], np.cumsum(np.array(more, np.int64))))
        before = np.searchsorted(np.array(y, np.int64), np.array(a, np.int64), "right")  # edits that end where the span starts, or earlier
        begun = np.searchsorted(np.array(x, np.int64), np.array(b, np.int64), "left")
        out.append([int(total[k]) if n <= k else None for k, n in zip(before, begun, strict=True)])
    return pa.array(out, pa.list_(pa.int32()))


def edits_of(docs: DataFrame, rules: dict[str, tuple[str, str]], keys: list[str], column: str = "text") -> DataFrame:
    """``keys, text, edits``: what every rule ``name: (pattern, new)`` would change, by place, longer before shorter, then by rule. Null texts have none."""
    found = F.concat(*[found_edits(F.col(column), p, new, rule) for rule, (p, new) in rules.items()])
    order = F.transform(found, lambda e: F.struct(e["start"].alias("s"), (-e["end"]).alias("l"), e["rule"].alias("r"), e.alias("e")))
    return docs.select(*keys, F.col(column).alias("text"), F.transform(F.sort_array(F.coalesce(order, F.array().cast(f"array<struct<s:int,l:int,r:string,e:{EDIT}>>"))), lambda x: x["e"]).alias("edits"))


def without_overlaps(edits: Column) -> Column:
    """Of sorted edits the first, and each next one that starts no earlier than the last kept one ends; edits that change nothing stay out of it."""
    return _without_overlaps(edits)


def _without(edits: Column, rules: Column) -> Column:
    """Edits of other rules than these; both come in as they are, since neither may be computed inside a lambda."""
    return _once(F.struct(edits.alias("edits"), rules.alias("rules")), lambda x: F.filter(x["edits"], lambda e: ~F.array_contains(x["rules"], e["rule"])))


def within_budget(edits: Column, text: Column, low: list[str], per_thousand: int = 3) -> Column:
    """Edits without those of rules in ``low`` that the noise budget lets stand.

    The budget is ``per_thousand`` hits for each thousand characters, one at least, rounded half to even. If the low rules hit no more than that, none of them is
    edited; else rules of fewest hits (then by name) are let stand as long as what is left reaches the budget.
    """
    budget = F.greatest(F.lit(1), F.bround(F.length(text) / 1000 * per_thousand).cast("int"))
    names = set(low)

    @_pass(T.ArrayType(_EDIT))
    def run(edits: pa.Array, budgets: pa.Array) -> pa.Array:
        kept = []
        for row, most in zip(_rows(edits, "rule"), budgets.to_pylist(), strict=True):
            gone = set() if row is None or most is None else _exempt([r for r in row[0] if r in names], most)
            kept.append(None if row is None else [r not in gone for r in row[0]])
        return _only(edits, kept)

    return run(edits, budget)


def keeping_terms(edits: Column, text: Column, terms: Column) -> Column:
    """Edits without those of rules that would take a term's last occurrence out of the text (all edits of such a rule go).

    A term is lost to a rule if all its occurrences in the text stand in what the rule's edits take away, and none in what they put there.
    """
    count = lambda t, x: F.try_divide(F.length(t) - F.length(F.replace(t, x, F.lit(""))), F.length(x))
    present = F.filter(F.transform(terms, lambda x: F.struct(x.alias("term"), count(text, x).alias("n"))), lambda x: x["n"] > 0)

    def losing(rule: Column, there: Column, pieces: Column) -> Column:
        own = F.filter(pieces, lambda e: e["edits"]["rule"] == rule)
        old = F.array_join(F.transform(own, lambda e: e["old"]), "\n")
        new = F.array_join(F.transform(own, lambda e: e["edits"]["new"]), "\n")
        both = F.array(F.struct(old.alias("old"), new.alias("new")))
        return F.exists(both, lambda b: F.exists(there, lambda x: (count(b["old"], x["term"]) >= x["n"]) & ~F.contains(b["new"], x["term"])))

    rules = F.array_distinct(F.transform(edits, lambda e: e["rule"]))
    pieces = F.arrays_zip(edits.alias("edits"), _taken(text, edits).alias("old"))
    own = F.struct(present.alias("there"), pieces.alias("pieces"), rules.alias("rules"))
    lost = _once(own, lambda x: F.when(F.size(x["there"]) > 0, F.filter(x["rules"], lambda r: losing(r, x["there"], x["pieces"]))).otherwise(F.array().cast("array<string>")))
    return _without(edits, lost)


def applied(text: Column, edits: Column) -> Column:
    """The text after edits that don't overlap, put together from what stands between them and what they put there."""
    return _put_together(text, edits)


def moved(place: Column, edits: Column) -> Column:
    """Where a place of the old text is in the new one; null inside what an edit took away or replaced."""
    inside = F.exists(edits, lambda e: (e["start"] <= place) & (place < e["end"]))
    shift = F.aggregate(F.filter(edits, lambda e: e["end"] <= place), F.lit(0), lambda a, e: (a + F.length(e["new"]) - (e["end"] - e["start"])).cast("int"))
    return F.when(~inside, place + shift)


def edited(docs: DataFrame, rules: dict[str, tuple[str, str]], keys: list[str], low: list[str] = (), per_thousand: int = 3, terms: Column | None = None) -> DataFrame:
    """``keys, text, edits, result``: the old text, the edits made to it and the new text.

    First the budget, then lost terms, then overlaps decide. Null texts stay null and have no edits; texts that no rule hits come back as they are.
    """
    found = edits_of(docs, rules, keys)
    if low:
        found = found.withColumn("edits", F.coalesce(within_budget(F.col("edits"), F.col("text"), list(low), per_thousand), F.col("edits")))
    if terms is not None:
        found = found.withColumn("edits", keeping_terms(F.col("edits"), F.col("text"), terms))
    found = found.withColumn("edits", without_overlaps(F.col("edits")))
    return found.withColumn("result", applied(F.col("text"), F.col("edits")))


def followed(findings: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Findings ``keys, start, end, ...`` of old texts with their places in the new ones (``new_start, new_end``); those that an edit touched are left out.

    A text's findings are followed together, so its edits stand beside them once.
    """
    own = findings.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in findings.columns if c not in keys])).alias("__found"))
    edits = F.col("edits")
    grown = F.transform(edits, lambda e: F.length(e["new"]) - (e["end"] - e["start"]))
    both = own.join(texts.select(*keys, "edits"), keys)
    both = both.select(*keys, "__found", _shifts(F.col("__found")["start"], F.col("__found")["end"], edits["start"], edits["end"], grown).alias("__by"))
    each = both.select(*keys, F.explode(F.arrays_zip("__found", "__by")).alias("__x")).where("__x.__by IS NOT NULL").select(*keys, "__x.__found.*", F.col("__x.__by").alias("__by"))
    return each.select(*findings.columns, (F.col("start") + F.col("__by")).alias("new_start"), (F.col("end") + F.col("__by")).alias("new_end"))
