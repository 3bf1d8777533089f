"""Clauses of two versions of a text: profiles, a band join that aligns them, and what is bound otherwise in the counterpart.

Clauses are rows. A clause's numbers, labels and what is bound to them come from its pieces (words, numbers and what stands between) by position.
A source clause is looked for near the place that its share of the text projects to: places are cut into bands as wide as the
window, so that an equi-join on text and band meets every clause inside the window and less than two windows of others. Nothing is paired
with all clauses of a text, and a long text's bands spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clause_words as W
from ..functions import markers as M
from ..functions import text as X
from . import edits as E

#: Clauses on either side of the projected place that are looked at.
WINDOW = 6
#: Below it the best clause counts as none.
ALIKE = 0.35
CLASSES = list(E.MARKERS)
_TIED = {"together": M.TOGETHER, "causing": M.CAUSING}


def clauses_of(text: Column) -> Column:
    """The clauses of a text, without blank ones; none of a null text."""
    return F.coalesce(F.filter(F.transform(F.split(text, W.CLAUSE_END, -1), X.strip), lambda c: F.length(c) > 0), F.array().cast("array<string>"))


def clause_rows(texts: DataFrame, keys: list[str], column: str, *more: Column) -> DataFrame:
    """``keys, more, n, at, clause``: the clauses of each text with their number and place."""
    held = texts.select(*keys, *more, clauses_of(F.col(column)).alias("__own")).withColumn("n", F.size("__own"))  # else each clause carries all of them
    rows = held.select(*[c for c in held.columns if c != "__own"], F.posexplode_outer("__own").alias("at", "clause"))
    return rows.where("at IS NOT NULL")  # outer: no filter that cuts each text once more


def _class_pattern(name: str) -> str:
    return "|".join([*([M.ZH[name]] if name in M.ZH else []), *([f"(?i:{M.EN[name]})"] if name in M.EN else [])])


def _at(pieces: Column, i: Column) -> Column:
    return F.coalesce(F.get(pieces, i), F.lit(""))


def _number(p: Column, i: Column) -> Column:
    """Sign, digits and unit of the number at i; a sign between two numbers or words is none."""
    before, tight = _at(p, i - 1), _at(p, i - 2)
    sign = F.when(before.rlike(r"[-−]$") & ~((F.length(before) == 1) & tight.rlike(r"^[\p{L}\d]")), F.lit("-")).otherwise("")
    after, then = _at(p, i + 1), _at(p, i + 2)
    percent = F.regexp_extract(after, r"^[%‰℃℉]", 0)
    unit = F.when(percent != "", percent).when(after.rlike(r"^\p{L}"), after).when(after.rlike(r"^\s+$") & then.rlike(r"^\p{L}"), then).otherwise("")
    return F.concat(sign, _at(p, i), F.when(F.length(unit) <= 24, unit).otherwise(""))


def _label(p: Column, i: Column) -> Column:
    """The name of the label at i, null if there is none."""
    own, gap, word = _at(p, i), _at(p, i - 1), F.lower(_at(p, i - 2))
    named = gap.rlike(r"^\s+$") & word.isin(W.LABEL_BEFORE)
    grouped = (F.lower(own) == "group") & gap.rlike(r"^\s+$") & word.isin(W.GROUP_BEFORE)
    return F.when(own.rlike(W.LABEL), F.when(named, F.concat_ws(" ", word, F.lower(own))).otherwise(F.lower(own))).when(grouped, F.concat_ws(" ", word, F.lit("group")))


def _triples(clause: Column) -> Column:
    """``subject>act>object`` of every verb of acting between two words."""
    out = []
    for acts, word, gap in ((W.ACTS_EN, "([A-Za-z][A-Za-z0-9_-]*)", r"\s+"), (W.ACTS_ZH, r"([A-Za-z甲乙丙丁戊己庚辛壬癸]|[\x{4e00}-\x{9fff}]{1,12}?)", "")):
        a, b, c = (F.regexp_extract_all(clause, F.lit(f"(?i){word}{gap}{acts}{gap}{word}"), F.lit(i)) for i in (1, 2, 3))
        act = F.transform(b, lambda x: _same_act(F.lower(x)))
        out.append(F.transform(F.arrays_zip(a.alias("a"), act.alias("b"), c.alias("c")), lambda t: F.concat_ws(">", F.lower(t["a"]), t["b"], F.lower(t["c"]))))
    return F.concat(*out)


def _same_act(verb: Column) -> Column:
    out = F.regexp_replace(verb, r"(?:s|ed)$", "")
    for pattern, name in reversed(W.SAME_ACT.items()):
        out = F.when(verb.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def profiles(clauses: DataFrame) -> DataFrame:
    """``clauses`` and ``numbers, labels, bindings, citations, directed, classes, bounds, terms, skeleton, sensitive``.

    bindings are ``label=number`` for every number and the nearest label within LABEL_REACH characters before it. classes counts each
    class of meaning, in the order of CLASSES and then ``together`` and ``causing``; a number's bound is no word of a class. terms are
    content words in order, Han characters one by one. skeleton is the clause's letters and digits, with # for numbers, @ for citations, and
    without words of the classes.
    """
    c = F.col("clause")
    cols = clauses.columns
    out = clauses.withColumns({"pieces": F.regexp_extract_all(c, F.lit(W.PIECE), F.lit(0)), "__bare": F.regexp_replace(c, E._BOUND.pattern, " ")})
    p = F.col("pieces")
    where = lambda f: F.filter(F.sequence(F.lit(0), F.size(p) - 1), f)
    out = out.withColumns({"__n": where(lambda i: F.get(p, i).rlike(r"^\d")), "__l": where(lambda i: _label(p, i).isNotNull())})

    def bound(i: Column) -> Column:
        last = F.array_max(F.filter("__l", lambda x: x < i))
        near = F.length(F.array_join(F.slice(p, last + 2, i - last - 1), "")) <= W.LABEL_REACH
        return F.when(near, F.concat_ws("=", _label(p, last), _number(p, i)))

    skeleton = F.regexp_replace(F.lower(c), W.CITATION, "@")
    for name in CLASSES:
        skeleton = F.regexp_replace(skeleton, _class_pattern(name), "")
    for pattern in _TIED.values():
        skeleton = F.regexp_replace(skeleton, pattern, "")
    skeleton = F.regexp_replace(F.regexp_replace(skeleton, r"\d+(?:[.,]\d+)*", "#"), r"[^a-z#@\x{4e00}-\x{9fff}]+", "")
    words = F.transform(F.filter(p, lambda x: x.rlike(r"^(?:[A-Za-z][A-Za-z0-9_-]+|[\x{4e00}-\x{9fff}])$")), F.lower)
    counted = [F.regexp_count("__bare", F.lit(_class_pattern(n))) for n in CLASSES] + [F.regexp_count(c, F.lit(x)) for x in _TIED.values()]
    phrases = F.map_from_arrays(*[F.array(*[F.lit(x) for x in side]) for side in (E._PHRASES.keys(), E._PHRASES.values())])
    kinds = F.transform(F.regexp_extract_all(c, F.lit(E._BOUND.pattern), F.lit(1)), lambda x: F.get(F.array(phrases), 0)[F.lower(F.regexp_replace(x, r"\s+", " "))])
    signs = F.transform(F.regexp_extract_all(c, F.lit(f"{M.COMPARATOR}|{M.EQUATION}"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))
    out = out.withColumns(
        {
            "numbers": F.transform("__n", lambda i: _number(p, i)),
            "labels": F.array_sort(F.array_distinct(F.transform("__l", lambda i: _label(p, i)))),
            "bindings": F.array_sort(F.filter(F.transform("__n", bound), lambda x: x.isNotNull())),
            "citations": F.array_sort(F.regexp_extract_all(c, F.lit(W.CITATION), F.lit(0))),
            "directed": _triples(c),
            "classes": F.array(*counted),
            "bounds": F.array_sort(F.concat(kinds, signs)),
            "terms": F.filter(words, lambda x: ~x.isin(W.STOP)),
            "skeleton": skeleton,
        }
    )
    facts = ["numbers", "labels", "citations", "bounds"]
    some = F.exists("classes", lambda x: x > 0)
    for f in facts:
        some = some | (F.size(f) > 0)
    return out.select(*cols, *facts, "bindings", "directed", "classes", "terms", "skeleton", some.alias("sensitive"))


_HAN = r"[\x{4e00}-\x{9fff}]"
_ZH_TIED, _EN_TIED = zip(*(p.split("|(?i:") for p in _TIED.values()), strict=True)
#: What every clause with facts has: a digit, a sign, a one-letter label, or a word of a class. Han words are tried at Han characters and English ones where a word
#: begins, so that other places cost one look.
HINT = "|".join(
    [
        r"[\d<>=≤≥＜＞≦≧≠≈≃∝甲乙丙丁戊己庚辛壬癸]",
        r"[A-Z](?<![^\P{L}\x{4e00}-\x{9fff}][A-Z])(?![^\P{L}\x{4e00}-\x{9fff}])",  # a label may stand beside Han characters
        rf"(?={_HAN})(?:{'|'.join([*M.ZH.values(), *_ZH_TIED])})",
        rf"(?<![A-Za-z])(?=[A-Za-z])(?i:group\b|et\s+al|{'|'.join([*M.EN.values(), *(p[:-1] for p in _EN_TIED)])})",
    ]
)


def with_facts(clauses: DataFrame) -> DataFrame:
    """The profiles of clauses with facts; one pattern tells most of the others before anything is profiled."""
    held = profiles(clauses.where(F.col("clause").rlike(HINT)))
    told = held.withColumn("__sure", F.explode(F.array("sensitive")))  # a generator, lest the filter be pushed below it and profile all clauses once more
    return told.where("__sure").drop("__sure")


def edit_share(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text; 1 for two empty ones."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def matched_share(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks as a share of both texts' (an Arrow helper; columns have none)."""
    return E.similarity_udf(a, b)


FACTS = ["numbers", "labels", "bindings", "citations", "directed", "classes", "bounds", "terms", "skeleton"]


def aligned(pairs: DataFrame, keys: list[str], before: str, after: str, window: int = WINDOW, likeness: Callable[[Column, Column], Column] = edit_share) -> DataFrame:
    """``keys, at, to, score, a, b``: every source clause with facts, and the clause of the other version it fits best (null if that has none).

    A clause at place i of n is expected at i (m - 1) / (n - 1) of the other's m, rounded half to even; the best of those up to ``window`` away
    has the highest sum of likeness of skeletons, share of common terms and, if the source has labels, 1.5 for the same, -1.5 for
    other and -0.6 for none; of equally good ones the first. Keys name a pair of texts; null and empty texts have no clauses.
    """
    width = 2 * window + 1
    own = with_facts(clause_rows(pairs, keys, before, F.size(clauses_of(F.col(after))).alias("__m")))
    last = F.greatest(F.col("__m") - 1, F.lit(0))
    expected = F.bround(F.col("at") * last / F.greatest(F.col("n") - 1, F.lit(1))).cast("int")
    own = own.select(*keys, "at", expected.alias("__e"), F.struct("clause", *FACTS).alias("a"))
    low, high = (F.floor((F.col("__e") + w) / width) for w in (-window, window))
    banded = own.withColumn("__band", F.explode(F.array_distinct(F.array(low, high))))
    other = clause_rows(pairs, keys, after).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("at").alias("to"), "clause", F.floor(F.col("at") / width).alias("__own"))
    same = F.col("__band") == F.col("__own")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    same = same & (F.abs(F.col("to") - F.col("__e")) <= window)
    other = profiles(other.join(banded.select(*keys, "__band", "__e"), same, "left_semi"))  # only what a source clause looks at is profiled
    met = banded.join(other.select(*[f"__{k}" for k in keys], "to", "__own", F.struct("clause", *FACTS).alias("b")), same, "left")
    x, y = F.col("a"), F.col("b")
    common = F.size(F.array_intersect(x["terms"], y["terms"])) / F.greatest(F.size(F.array_union(x["terms"], y["terms"])), F.lit(1))
    label = F.when(F.size(x["labels"]) == 0, 0.0).when(x["labels"] == y["labels"], 1.5).when(F.size(y["labels"]) > 0, -1.5).otherwise(-0.6)
    scored = met.withColumn("score", likeness(x["skeleton"], y["skeleton"]) + common + label)
    best = F.max_by(F.struct("to", "score", "b"), F.when(F.col("to").isNotNull(), F.struct("score", -F.col("to")))).alias("x")
    return scored.groupBy(*keys, "at").agg(F.any_value("a").alias("a"), best).select(*keys, "at", "x.to", "x.score", "a", "x.b")


def local_changes(pairs: DataFrame, keys: list[str], before: str, after: str, window: int = WINDOW, likeness: Callable[[Column, Column], Column] = edit_share) -> DataFrame:
    """``keys, at, to, before, after, reasons`` of source clauses with facts whose counterpart binds them otherwise.

    reasons: ``missing`` (the other version has no clause), ``not aligned``, ``numbers``, ``citations``, ``bindings``, ``direction``,
    ``label`` (a labelled clause reads otherwise), ``bounds``, each class whose count differs, ``order`` (the same terms in another order).
    """
    x, y = F.col("a"), F.col("b")
    says = lambda test, name: F.when(test, F.lit(name))
    classes = F.zip_with(x["classes"], y["classes"], lambda p, q: p != q)
    reasons = [
        says(F.col("score") < ALIKE, "not aligned"),
        says(x["numbers"] != y["numbers"], "numbers"),
        says(x["citations"] != y["citations"], "citations"),
        says(x["bindings"] != y["bindings"], "bindings"),
        says(x["directed"] != y["directed"], "direction"),
        says((F.size(x["labels"]) > 0) & (x["skeleton"] != y["skeleton"]), "label"),
        says(x["bounds"] != y["bounds"], "bounds"),
        *[says(F.get(classes, i), name) for i, name in enumerate([*CLASSES, *_TIED])],
        says((F.size(x["terms"]) >= 2) & (x["terms"] != y["terms"]) & (F.array_sort(x["terms"]) == F.array_sort(y["terms"])), "order"),
    ]
    all_of = F.when(F.col("to").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*reasons)))
    out = aligned(pairs, keys, before, after, window, likeness).withColumn("reasons", all_of).where(F.size("reasons") > 0)
    return out.select(*keys, "at", "to", x["clause"].alias("before"), y["clause"].alias("after"), "reasons")
