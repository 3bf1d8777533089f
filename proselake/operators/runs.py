"""Runs of one language inside a text: cut by lines, routed by lane, edited, and put together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import autofix as A

RUN = "struct<lane:string,start:int,text:string>"


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` that computes ``x`` once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), 0)


def _lane(line: Column) -> Column:
    """The lane of a line. ASCII has no Han: with letters it is en, without them what an empty line is."""
    bare = F.when(F.octet_length(line) == F.length(line), F.when(line.rlike("[A-Za-z]"), "a").otherwise("")).otherwise(F.rtrim(line, F.lit("\n")))
    return _once(bare, lambda x: _once(A.product_language(x), lambda lang: F.when((lang == "zh") & x.rlike("[A-Za-z]"), "protected").otherwise(lang)))


def runs(text: Column) -> Column:
    """Array of ``lane, start, text``: neighbouring lines of one lane with the line feeds behind them; the texts concatenate to the text.

    Line feeds before the first line are a run of lane ``raw``. Lanes are those of ``lane``: zh, en, mixed and protected. A null text has no array, an empty
    one an empty array.
    """
    lines = F.transform(F.regexp_extract_all(text, F.lit(r"[^\n]+\n*|\n+"), F.lit(0)), lambda x: F.struct(F.when(x.startswith("\n"), "raw").otherwise(_lane(x)).alias("lane"), x.alias("text")))

    def islands(own: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(own, i)["lane"] != F.get(own, i - 1)["lane"])
        firsts = F.when(F.size(own) > 0, F.filter(F.sequence(F.lit(0), F.size(own) - 1), new)).otherwise(F.array().cast("array<int>"))
        whole = lambda a, b: F.array_join(F.transform(F.slice(own, a + 1, b - a), lambda x: x["text"]), "")
        return _once(firsts, lambda f: F.transform(f, lambda a, k: F.struct(F.get(own, a)["lane"].alias("lane"), whole(a, F.coalesce(F.get(f, k + 1), F.size(own))).alias("text"))))

    def placed(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{RUN}>").alias("out"))
        step = lambda s, r: F.struct((s["at"] + F.length(r["text"])).alias("at"), F.concat(s["out"], F.array(F.struct(r["lane"].alias("lane"), s["at"].alias("start"), r["text"].alias("text")))).alias("out"))
        return F.aggregate(found, start, step, lambda s: s["out"])

    return F.when(text.isNotNull(), _once(_once(lines, islands), placed))


def edited_runs(text: Column, edits: dict[str, Callable[[Column], Column]]) -> Column:
    """The text with each run of a lane in ``edits`` edited between the line feeds at its ends; all other runs, and those line feeds, byte for byte as they were.

    An edit that comes out null or blank leaves its run as it was.
    """

    def put(own: Column, edit: Callable[[Column], Column]) -> Column:
        ends = lambda core: F.substr(own, F.length(core) + 1)
        said = lambda core, new: F.when(F.length(F.trim(new)) > 0, F.concat(new, ends(core))).otherwise(own)
        return _once(F.rtrim(own, F.lit("\n")), lambda core: _once(edit(core), lambda new: said(core, new)))

    def one(r: Column) -> Column:
        out = r["text"]
        for lane, edit in edits.items():
            out = F.when(r["lane"] == lane, put(r["text"], edit)).otherwise(out)
        return out

    return F.array_join(F.transform(runs(text), one), "")
