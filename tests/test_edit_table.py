"""Edits as data against a plain walk over strings."""

import random
import re

from pyspark.sql import functions as F

from proselake.operators import edit_table as T

RULES = {"twin": ("(a+)b", "$1"), "gap": (" {2,}", " "), "mark": ("[#*]{2,}", ""), "tail": ("[#*]c", "<c>"), "dash": ("—", ", ")}
TEXTS = ["", "aab  ##c—x", "####c aab  ab", "no hits at all", "😀ab  é##c", "—" * 9 + " ab", "ab" * 30]


def plain(text):
    found = []
    for rule, (p, new) in RULES.items():
        to = re.sub(r"\$(\d)", r"\\\1", new)
        found += [(m.start(), -m.end(), rule, m.expand(to)) for m in re.finditer(p, text)]
    kept, end = [], 0
    for start, neg, rule, new in sorted(found):
        if start >= end:
            kept.append((start, -neg, new, rule))
            end = -neg
    out, at = "", 0
    for start, stop, new, _ in kept:
        out, at = out + text[at:start] + new, stop
    return kept, out + text[at:]


def texts():
    rng = random.Random(1)
    return TEXTS + ["".join(rng.choice("ab c#*—é") for _ in range(rng.randrange(60))) for _ in range(150)]


def test_edits_like_a_walk(spark):
    df = spark.createDataFrame([*enumerate(texts()), (999, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in T.edited(df, RULES, ["doc_id"]).collect()}
    assert got[999].result is None and got[999].edits == []
    for i, t in enumerate(texts()):
        kept, out = plain(t)
        assert [tuple(e) for e in got[i].edits] == kept and got[i].result == out, t


def test_places_follow(spark):
    """Every character that no edit took stands at its new place."""
    df = spark.createDataFrame([*enumerate(texts())], "doc_id long, text string")
    made = T.edited(df, RULES, ["doc_id"])
    at = df.select("doc_id", F.posexplode(F.split("text", "")).alias("start", "c")).withColumn("end", F.col("start") + 1)
    rows = T.followed(at, made, ["doc_id"]).join(made.select("doc_id", "result"), "doc_id").collect()
    assert len(rows) > 1000 and all(r.new_end == r.new_start + 1 and (r.result + " ")[r.new_start : r.new_end] == (r.c or " ") for r in rows if r.c)
    untouched = sum(sum(not any(s <= k < e for s, e, _, _ in plain(t)[0]) for k in range(len(t))) for t in texts())
    assert sum(bool(r.c) for r in rows) == untouched


def test_budget_and_terms(spark):
    rows = [(1, "ab" + "  " * 1 + "—"), (2, "x  y  z  — — — ab"), (3, "—" * 4 + "  " + "x" * 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    low = T.edited(df, {k: RULES[k] for k in ("twin", "gap", "dash")}, ["doc_id"], low=["gap", "dash"])
    got = {r.doc_id: sorted({e.rule for e in r.edits}) for r in low.collect()}
    # budgets 1, 1 and 5: both rules together hit 2, 6 and 5 times
    assert got == {1: ["gap", "twin"], 2: ["gap", "twin"], 3: []}
    terms = spark.createDataFrame([(1, "key aab end", ["aab"]), (2, "aab then aab", ["aab"]), (3, "aab and ab. key", ["key", "ab."]), (4, "ab", [])], "doc_id long, text string, terms array<string>")
    rules = {"cut": ("aab then", "so"), "twin": ("(a+)b", "$1")}
    got = {r.doc_id: r.result for r in T.edited(terms.select("doc_id", "text"), rules, ["doc_id"]).collect()}
    assert got == {1: "key aa end", 2: "so aa", 3: "aa and a. key", 4: "a"}
    kept = T.edits_of(terms, rules, ["doc_id", "terms"]).withColumn("edits", T.keeping_terms(F.col("edits"), F.col("text"), F.col("terms")))
    got = {r.doc_id: r.r for r in kept.select("doc_id", T.applied(F.col("text"), T.without_overlaps(F.col("edits"))).alias("r")).collect()}
    assert got == {1: "key aab end", 2: "so aab", 3: "aa and a. key", 4: "a"}


def test_no_texts(spark):
    assert T.edited(spark.createDataFrame([], "doc_id long, text string"), RULES, ["doc_id"]).count() == 0


def test_time_follows_the_edits(spark):
    """A text of many edits: each step of a fold used to copy all edits so far."""
    import time

    df = spark.createDataFrame([(1, "##a—b  " * 30_000)], "doc_id long, text string")
    t = time.perf_counter()
    row = T.edited(df, RULES, ["doc_id"]).select(F.size("edits").alias("n"), F.md5("result").alias("m"), F.length("result").alias("l")).first()
    assert (row.n, row.l) == (90_000, 150_000) and time.perf_counter() - t < 20
