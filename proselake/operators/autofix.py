"""Deterministic edits with guards: each step is kept only if no fact is lost, and the whole only if nothing that counts changed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import transforms as T
from . import diagnose as D
from . import edits as E

#: Rules whose edits are safe to make without a reader, in order.
SAFE = ["zh:L01", "zh:L05", "zh:L07", "zh:L09", "zh:F01", "zh:F02"]


def _steps(name: str) -> list[tuple[re.Pattern, str]]:
    python = lambda p: p.replace(T.SPACE, r"\s").replace("(?md)", "(?m)")
    return [(re.compile(python(p)), re.sub(r"\$(\d)", r"\\\1", new)) for p, new in T.REGISTRY[name]]


def codefix(text: str, rules: list[str] = SAFE) -> tuple[str, list[tuple[str, int]]]:
    """The text after each rule's edits, line by line for Chinese lines; a rule that loses a number, citation or name is undone.

    Returns the edits by rule and number, most first. If the whole changes facts or meaning, the text comes back as it was.
    """
    lines, log = text.split("\n"), {}
    kit = [(r, _steps(r)) for r in rules]
    for i, line in enumerate(lines):
        if not line.strip() or D.language(line) != "zh":
            continue
        for rule, steps in kit:
            new, n = lines[i], 0
            for pattern, to in steps:
                new, k = pattern.subn(to, new)
                n += k
            if n and not E.compare(lines[i], new)["removed"]:
                lines[i], log[rule] = new, log.get(rule, 0) + n
    out = "\n".join(lines)
    changed = E.compare(text, out)
    if changed["added"] or changed["removed"]:
        return text, []
    return out, sorted(log.items(), key=lambda x: (-x[1], x[0]))


def autofix(text: str) -> tuple[str, int]:
    """The 31 checks' safe replacements under one final guard; the text itself if there is nothing to do or the guard objects."""
    found = [f for f in D.policy_text(text) if f[2] == "safe" and f[6] is not None]
    if not found:
        return text, 0
    out = D.apply_safe(text, found)
    changed = E.compare(text, out)
    return (text, 0) if changed["added"] or changed["removed"] or changed["semantic"] else (out, len(found))


def fixed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id, text, code_edits, safe_edits`` after both layers; null texts stay null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                if t is None:
                    rows.append((None, 0, 0))
                    continue
                new, log = codefix(t)
                new, n = autofix(new)
                rows.append((new, sum(k for _, k in log), n))
            t, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[key, "text", "code_edits", "safe_edits"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, text string, code_edits long, safe_edits long")


def product_language(text: Column) -> Column:
    """``zh``, ``en`` or ``mixed``: mixed holds Han and an English phrase of three words."""
    han, phrase = text.rlike(X.HAN), text.rlike(r"[A-Za-z]+(?:[ \t]+[A-Za-z]+){2,}")
    return F.when(han & phrase, "mixed").otherwise(X.language(text))


def lane(text: Column) -> Column:
    """``protected`` for Chinese with Latin in it, else the language."""
    lang = product_language(text)
    return F.when((lang == "zh") & text.rlike("[A-Za-z]"), "protected").otherwise(lang)


def islands(text: Column) -> Column:
    """Runs of Latin and ASCII between other characters that hold a letter."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{IsLatin}\p{ASCII}]+"), F.lit(0)), X.strip), lambda s: s.rlike("[A-Za-z]"))


def in_order(items: str, text: str) -> Column:
    """Whether all of an array column's items occur in the text column one behind the other."""
    return F.expr(
        f"aggregate(`{items}`, named_struct('at', 1, 'ok', true), (a, x) -> named_struct('at', cast(locate(x, `{text}`, a.at) + length(x) as int), 'ok', a.ok and locate(x, `{text}`, a.at) > 0), a -> a.ok)"
    )
