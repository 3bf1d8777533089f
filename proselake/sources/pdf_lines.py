"""Lines of a page merged to paragraphs, whatever tool read the page."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_END = re.compile(r"[。！？.!?：:”\"」』）)]$")
_NEW = re.compile(r"^\s*(?:第[一二三四五六七八九十\d]+[章节]|[一二三四五六七八九十]+、|\d+(?:\.\d+)*[.、\s]|[（(]\d+[）)]|[-•·*]\s|#)")
_NUMBER = re.compile(r"^\s*(?:[-—]?\s*\d{1,4}\s*[-—]?|第\s*\d+\s*页.*|Page\s+\d+.*)\s*$", re.I)
_CJK = re.compile("[一-鿿，。！？；：、]")


def merge_lines(lines: list[str]) -> list[str]:
    """Paragraphs: page numbers go; a line ends one if it ends a sentence and is short of the usual width, or if a heading or
    list mark follows; lines meet without a blank between Chinese characters."""
    kept = [x.strip() for x in lines if x.strip() and not _NUMBER.match(x)]
    if not kept:
        return []
    widths = sorted(map(len, kept))
    usual = widths[len(widths) // 2]
    out = [kept[0]]
    for last, line in zip(kept, kept[1:], strict=False):
        if _NEW.match(line) or (_END.search(last) and len(last) < 0.85 * usual) or len(last) < 0.5 * usual:
            out.append(line)
        else:
            blank = "" if _CJK.match(out[-1][-1]) and _CJK.match(line[0]) else " "
            out[-1] = out[-1][:-1] + line if re.search(r"[A-Za-z]-$", out[-1]) and line[0].islower() else out[-1] + blank + line
    return out


def merged_lines(lines: Column) -> Column:
    """The paragraphs of a column of line arrays; null stays null."""

    @F.arrow_udf("array<string>")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else merge_lines([x or "" for x in p]) for p in pages.to_pylist()], pa.list_(pa.string()))

    return run(lines)
