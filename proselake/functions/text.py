"""Column builders over prose: paragraphs, sentences, matches with offsets, language, masks, normal form.

Offsets are code points, half open. White space is Unicode's wherever a text is stripped. What needs offsets of all matches is an
Arrow pass over a batch of texts; everything else is a column expression.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{4e00}-\x{9fff}]"
SPAN = "array<struct<start:int,end:int,matched:string>>"

# Characters that normalisation deletes or turns into a blank.
INVISIBLE = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}\x{180E}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
VARIATION = r"[\x{FE00}-\x{FE0F}]"
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
ODD_SPACE = r"[\x{2000}-\x{200A}\x{202F}\x{205F}]"


#: Unicode's white space but for the line feed.
WHITE = "\t\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Texts of a batch that are Python objects at once; the rest of it, and what was found, stays Arrow's.
HELD = 64


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _lists(found: list[list[tuple] | None], columns: dict[str, pa.DataType]) -> pa.Array:
    """Rows of tuples, or of null, as an array of lists of structs."""
    at = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) if x else 0 for x in found], out=at[1:])
    flat = list(zip(*(row for x in found if x for row in x), strict=True)) or [()] * len(columns)
    held = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, columns.values(), strict=True)], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(at), held, mask=pa.array([x is None for x in found], pa.bool_()))


_SPAN = {"start": pa.int32(), "end": pa.int32(), "matched": pa.string()}


def _each(text: Column, kind: str, columns: dict[str, pa.DataType], work: Callable[[str], list[tuple]]) -> Column:
    """What ``work`` finds in each text, by Arrow batches; null stays null."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(i, HELD).to_pylist() for i in range(0, max(1, len(texts)), HELD))
        return pa.concat_arrays([_lists([None if t is None else work(t) for t in own], columns) for own in parts])

    return run(text)


def find_all(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` (Python's syntax) with its offsets, in order; time and memory follow the text.

    Columns can name all matches, but adding up their offsets copies a growing list at each match, so this is an Arrow pass.
    """
    own = re.compile(pattern)
    return _each(text, SPAN, _SPAN, lambda t: [(*m.span(), m.group()) for m in own.finditer(t)])


def line_spans(text: str) -> list[tuple[int, int, str]]:
    """Non-blank lines of a text, stripped, with offsets."""
    out, at = [], 0
    for line in text.split("\n"):
        own = line.strip()
        if own:
            start = at + len(line) - len(line.lstrip())
            out.append((start, start + len(own), own))
        at += len(line) + 1
    return out


def paragraphs(text: Column) -> Column:
    """Non-blank lines, stripped, with offsets: array<struct<start, end, matched>>."""
    return _each(text, SPAN, _SPAN, line_spans)


def last_before(text: Column, pattern: str, label: str, within: int) -> Column:
    """Each match of ``pattern`` with the match of ``label`` that ends last before it, null if that ends more than ``within`` characters away."""
    own, mark = re.compile(pattern), re.compile(label)

    def work(t: str) -> list[tuple]:
        out, marks = [], mark.finditer(t)
        last, ahead = None, next(marks, None)
        for m in own.finditer(t):
            while ahead is not None and ahead.end() <= m.start():
                last, ahead = ahead, next(marks, None)
            near = last is not None and m.start() - last.end() <= within
            out.append((m.start(), m.group(), last.group() if near else None))
        return out

    kind = "array<struct<start:int,number:string,label:string>>"
    return _each(text, kind, {"start": pa.int32(), "number": pa.string(), "label": pa.string()}, work)


def rule_spans(text: Column, rules: dict[str, str]) -> Column:
    """All matches of all rules in one pass, with the number of the paragraph that holds them (null: none)."""
    every = [(rule, re.compile(p)) for rule, p in rules.items()]

    def work(t: str) -> list[tuple]:
        paras = line_spans(t)
        starts, out = [p[0] for p in paras], []
        for rule, own in every:
            for m in own.finditer(t):
                k = bisect_right(starts, m.start()) - 1
                out.append((rule, *m.span(), m.group(), k if k >= 0 and m.end() <= paras[k][1] else None))
        return out

    kind = "array<struct<rule:string,start:int,end:int,matched:string,para:int>>"
    return _each(text, kind, {"rule": pa.string(), **_SPAN, "para": pa.int32()}, work)


def repeated_grams(text: Column, n: int) -> Column:
    """How many of the overlapping n-character grams occur again in the text and are no white space throughout, and how many there are."""

    @F.arrow_udf("struct<repeated:bigint,grams:bigint>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            size = max(0, len(t or "") - n + 1)
            if not size:
                out.append((0, 0))
                continue
            points, number = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
            key = np.zeros(size, np.int64)
            for k in range(n):  # ranks of grams one character longer at a time
                key = key * len(points) + number[k : k + size]
                if k < n - 1 and len(points) ** (k + 2) >= 1 << 62:
                    key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            blank = np.array([chr(c).isspace() for c in points], bool)[number]
            blanks = np.concatenate(([0], np.cumsum(blank)))
            full = blanks[first + n] - blanks[first] < n
            out.append((int(count[(count > 1) & full].sum()), size))
        repeated, grams = zip(*out, strict=True) if out else ((), ())
        return pa.StructArray.from_arrays([pa.array(repeated, pa.int64()), pa.array(grams, pa.int64())], names=["repeated", "grams"])

    return run(text)


def sentences_en(paragraph: Column) -> Column:
    """Split after . ! ? and white space; blank pieces go."""
    return F.filter(F.transform(F.split(paragraph, r"(?U)(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 0)


def sentences_zh(paragraph: Column) -> Column:
    """Up to and with a full stop of Chinese prose or a line feed; blank pieces go."""
    cut = F.regexp_extract_all(paragraph, F.lit(r"[^。！？；\n]*[。！？；\n]|[^。！？；\n]+$"), F.lit(0))
    return F.filter(F.transform(cut, strip), lambda s: F.length(s) > 0)


def language(text: Column) -> Column:
    """``zh`` for four Han characters and a marker of Chinese prose, or more than 0.3 Han of all letters, or no letter.

    Letters are counted by what is left without their runs; counting matches would list every letter.
    """
    count = lambda kind: F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))
    zh, en = count(HAN), count("[A-Za-z]")
    marked = (zh >= 4) & text.rlike("[，。！？；]|本文|本研究|研究|方法|结果|分析|探讨")
    share = F.try_divide(zh, zh + en)
    return F.when((zh + en == 0) | marked | (share > 0.30), "zh").otherwise("en")


def mask(text: Column, pattern: str = HAN) -> Column:
    """The text with every match character a blank: offsets stay."""
    return F.regexp_replace(text, pattern, " ")


def normal_form(text: Column) -> Column:
    """The text without invisible, variation and control characters, odd blanks as blanks, line ends as line feeds."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    for deleted in (INVISIBLE, VARIATION, CONTROL):
        t = F.regexp_replace(t, deleted, "")
    return F.regexp_replace(t, ODD_SPACE, " ")


def normal_report(text: Column) -> dict[str, Column]:
    """How many characters each step changes, counted on what the steps before it left."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    out = {"carriage_returns": F.regexp_count(text, F.lit(r"\r\n?"))}
    for name, deleted in (("invisible", INVISIBLE), ("variation", VARIATION), ("control", CONTROL)):
        out[name] = F.regexp_count(t, F.lit(deleted))
        t = F.regexp_replace(t, deleted, "")
    out["odd_spaces"] = F.regexp_count(t, F.lit(ODD_SPACE))
    return out


def population_cv(values: Column) -> Column:
    """Population standard deviation over mean of integers; 0 for fewer than two or a sum of 0."""
    n = F.size(values).cast("long")
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    square = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return F.when((n < 2) | (total == 0), F.lit(0.0)).otherwise(F.try_divide(F.sqrt((n * square - total * total).cast("double")), total.cast("double")))
