"""Host-level quality rules: what documents break is counted by host, rates are shrunk, and verdicts are joined back. DataFrame functions only.

Every text is measured inside its own row. A document fails as such by the base rules; three further rules (many symbols,
repeated lines, odd word lengths) are judged by host. For every rule, hosts' failure rates are taken as draws of one beta
distribution whose mean and spread come from all hosts by weighted moments; a host's rate is the mean of its posterior, so that a host
of a few documents stands near the whole corpus and one of many near its own share. A shrunk rate puts a rule of a host into
one of three states: below ``LOW`` a failure counts as a false alarm, from there on documents that fail go, and above
``HIGH`` the host is rejected with all that it serves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, maybe_broadcast

#: Hosts up to which their verdicts are broadcast; beyond it they are joined by a shuffle that splits hot hosts.
BROADCAST_ROWS = 1 << 18
#: Words of a window; hashes of windows are paired up from those of half the width.
WINDOW = 8
#: Shrunk rates from which a failure counts, and above which the host goes.
LOW, HIGH = 0.01, 0.5
#: What a host's documents are judged by; a true value is a failure.
HOST_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
    "lengths": "word_chars > 10 * n_words OR word_chars < 3 * n_words",
}
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` that computes ``x`` once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), 0)


def _covered(hashes: Column) -> Column:
    """The words in windows whose hash occurs twice or more; ``hashes`` has one for each window."""

    def repeats(numbered: Column) -> Column:
        pairs = F.zip_with(F.slice(numbered, 2, F.size(numbered)), numbered, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

    def words(places: Column) -> Column:
        steps = F.zip_with(F.slice(places, 2, F.size(places)), places, lambda a, b: F.least(F.coalesce(a - b, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _once(_once(numbered, repeats), words)


def measured(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words`` of every text; null counts as empty.

    Windows are told apart by 64-bit hashes of the words' 64-bit hashes, within one text only.
    """
    text = F.col("__text")
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    kept = rows.columns[:-1]
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    counts = {"n_symbols": F.regexp_count(text, F.lit(_SYMBOL)).cast("long"), "__lines": lines}
    rows = rows.select(*kept, words.alias("__words"), *[c.alias(n) for n, c in counts.items()])
    size = {"word_chars": F.length(F.array_join("__words", "")).cast("long"), "n_words": F.size("__words").cast("long")}
    lines = {"n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "n_lines": F.size("__lines").cast("long")}
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    rows = rows.select(*kept, "n_symbols", *[c.alias(n) for n, c in {**size, **lines}.items()], hashes.alias("__hashes"))
    step = 1
    while step < WINDOW:
        there = F.slice("__hashes", step + 1, F.greatest(F.size("__hashes") - step, F.lit(0)))
        ahead = F.slice("__hashes", 1, F.greatest(F.size("__hashes") - step, F.lit(0)))
        rows = rows.withColumn("__hashes", F.zip_with(ahead, there, lambda x, y: F.xxhash64(x, y)))
        step *= 2
    repeated = F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), _covered(F.col("__hashes")))
    return rows.select(*kept, *size, "n_symbols", *lines, F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"))


def host_counts(rows: DataFrame) -> DataFrame:
    """``host, n_docs, failed_<rule>`` of ``host`` and the measures; rows without a host are left out."""
    failed = {r: F.count_if(F.expr(x)).alias(f"failed_{r}") for r, x in HOST_RULES.items()}
    return rows.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), *failed.values())


def beta_priors(counts: DataFrame) -> dict[str, tuple[float, float]]:
    """For every rule (a, b) of the beta distribution that hosts' rates are drawn from; sums over all hosts, a few numbers.

    The mean is the rate of all documents; the intraclass correlation c comes from weighted squared deviations of the hosts' rates,
    and a + b = 1 / c - 1. Where hosts differ no more than chance has it, a + b is the number of all documents (the most it can be).
    """
    sums = [F.sum(F.col(f"failed_{r}").cast("double")).alias(f"f_{r}") for r in HOST_RULES]
    squares = [F.sum(F.col(f"failed_{r}").cast("double") * F.col(f"failed_{r}") / F.col("n_docs")).alias(f"s_{r}") for r in HOST_RULES]
    n2 = F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("n2")
    got = counts.agg(F.count("*").alias("hosts"), F.sum(F.col("n_docs").cast("double")).alias("n"), n2, *sums, *squares).first()
    out = {}
    for r in HOST_RULES:
        n, m = got["n"] or 0.0, (got[f"f_{r}"] or 0.0) / got["n"] if got["n"] else 0.0
        between = (got[f"s_{r}"] or 0.0) - n * m * m
        chance = m * (1 - m)
        spread = n - got["n2"] / n - (got["hosts"] - 1) if n else 0.0
        c = (between - chance * (got["hosts"] - 1)) / (chance * spread) if chance > 0 and spread > 0 else 0.0
        strength = min(max(1 / c - 1, 1.0), max(n, 1.0)) if c > 0 else max(n, 1.0)
        out[r] = (m * strength, (1 - m) * strength)
    return out


def host_verdicts(rows: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``host, n_docs, rate_<rule>, strict_<rule>, rejected`` of ``host`` and the measures: shrunk rates and what follows from them."""
    counts = cut(host_counts(rows))
    out = counts
    for r, (a, b) in beta_priors(counts).items():
        rate = (F.col(f"failed_{r}") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"strict_{r}", F.col(f"rate_{r}") >= low)
    rejected = F.greatest(*[F.col(f"rate_{r}") for r in HOST_RULES]) > high
    return cut(out.withColumn("rejected", rejected).drop(*[f"failed_{r}" for r in HOST_RULES]))


def judged(docs: DataFrame, host: Column | str = "source", low: float = LOW, high: float = HIGH) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, host_rejected`` of every row.

    Words are runs of anything but the six ASCII white-space characters. Kept is what passes the base rules, comes from no rejected host and
    breaks no rule that its host is held to. Null and empty texts have no words and fail. Rows without a host are judged
    by the base rules alone, and count for no host. Very long texts are measured whole, inside their row; repeated rows are rows of
    their own and count each. An empty table gives an empty one; other columns are neither read nor returned.
    """
    host = F.col(host) if isinstance(host, str) else host
    rows = cut(measured(docs, F.col("doc_id"), host.cast("string").alias("host")))
    verdicts = maybe_broadcast(host_verdicts(rows, low, high), BROADCAST_ROWS).withColumnRenamed("host", "__host")
    joined = rows.join(verdicts, F.col("host") == F.col("__host"), "left")
    breaks = F.lit(False)
    for r, x in HOST_RULES.items():
        breaks = breaks | (F.expr(x) & F.coalesce(f"strict_{r}", F.lit(False)))
    gone = F.coalesce("rejected", F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~(base_failed() | gone | breaks)).alias("kept"), "host", gone.alias("host_rejected"),
    )
