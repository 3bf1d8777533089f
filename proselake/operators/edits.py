"""Texts against texts: units, chunks, diffs, similarity, clause guards and candidate scores, as Arrow functions.

These carry state along a text, which no column expression does well; each works on one row, so plans stay narrow.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markers as M

# Zero-width and direction marks that count as nothing.
UNCOUNTED = set("\u00ad\u180e\u200b\u200c\u200d\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069\ufeff")
#: Diffs with more cells than this are one replaced block.
MOST_CELLS = 1_800_000
CHUNK = 3500
#: Texts of a batch that are Python objects at once.
HELD = 64


def _kind(c: str) -> str:
    """``skip`` invisible, ``space``, ``han``, ``word`` (Latin letter or digit), ``mark``, ``quote``, ``punct`` or ``other``."""
    if c.isspace():
        return "space"
    category = unicodedata.category(c)
    if c in UNCOUNTED or category in ("Cc", "Cf") or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef":
        return "skip"
    name = unicodedata.name(c, "")
    if name.startswith(("CJK UNIFIED IDEOGRAPH", "CJK COMPATIBILITY IDEOGRAPH")) or c == "〇":
        return "han"
    if category == "Nd" or (category[0] == "L" and ("LATIN" in name or c in "ªºK\u212b")):
        return "word"
    if category[0] == "M":
        return "mark"
    return "quote" if c in "'’" else "punct" if category[0] == "P" else "other"


def billable_units(text: str) -> dict[str, int]:
    """``words, han, other, total``: a Han character is a unit, a run of Latin letters and digits is one (marks and inner
    apostrophes included), punctuation is free, every other visible character is one."""
    kinds = [k for k in map(_kind, text) if k != "skip"]
    out, inside = Counter(), False
    for i, k in enumerate(kinds):
        if k == "quote":
            inside = inside and i + 1 < len(kinds) and kinds[i + 1] == "word"
            continue
        unit = {"han": "han", "other": "other", "word": None if inside else "words", "mark": None if inside else "other"}.get(k)
        if unit:
            out[unit] += 1
        inside = k == "word" or (k == "mark" and inside)
    return {"words": out["words"], "han": out["han"], "other": out["other"], "total": sum(out.values())}


#: Kinds by number, and of each code point that was met its kind's (255: not met yet).
KINDS = ("skip", "space", "han", "word", "mark", "quote", "punct", "other")
_MET = np.full(0x110000, 255, np.uint8)


def units_of(texts: list[str]) -> np.ndarray:
    """Of each text ``words, han, other, total`` as billable_units counts them, all texts at once."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = _MET[points]
    new = np.unique(points[own == 255])
    if len(new):
        _MET[new] = [KINDS.index(_kind(chr(c))) for c in new]
        own = _MET[points]
    shown = own != KINDS.index("skip")
    kinds, row = own[shown], np.repeat(np.arange(len(texts)), sizes)[shown]
    word, mark, quote = (kinds == KINDS.index(k) for k in ("word", "mark", "quote"))
    follows = np.zeros(len(kinds), bool)  # a word of the same text comes next
    follows[:-1] = word[1:] & (row[1:] == row[:-1])
    at = np.arange(len(kinds))
    last = np.maximum.accumulate(np.where(mark | (quote & follows), -1, at))  # the last that opens or ends a word, up to each
    last = np.concatenate(([-1], last[:-1]))[: len(kinds)]
    inside = (last >= 0) & word[last] & (row[last] == row)
    count = lambda some: np.bincount(row[some], minlength=len(texts))
    words, han, other = count(word & ~inside), count(kinds == KINDS.index("han")), count((kinds == KINDS.index("other")) | (mark & ~inside))
    return np.stack([words, han, other, words + han + other])


def visible_chars(text: str) -> int:
    """The first version's count: characters that are neither blank, invisible nor control."""
    hidden = lambda c: c.isspace() or c in UNCOUNTED or "\ufe00" <= c <= "\ufe0f" or (unicodedata.category(c) == "Cc")
    return sum(not hidden(c) for c in text)


def chunks(text: str, most: int = CHUNK) -> list[tuple[str, bool]]:
    """(text, editable) pieces that concatenate to the text: code and formulas whole and not editable, prose in pieces of at
    most ``most`` characters, cut behind a line feed, else behind a sentence in the second half, else hard."""
    kept, out, at = re.compile(r"```.*?(?:```|\Z)|\$\$.*?\$\$", re.S), [], 0
    for m in [*kept.finditer(text), None]:
        prose = text[at : m.start() if m else len(text)]
        while len(prose) > most:
            cut = prose.rfind("\n", 0, most) + 1
            if not cut:
                ends = [x.end() for x in re.finditer(r"[。！？]|[.!?](?=\s)", prose[:most]) if x.end() >= most // 2]
                cut = ends[-1] if ends else most
            out.append((prose[:cut], True))
            prose = prose[cut:]
        if prose:
            out.append((prose, True))
        if m:
            out.append((m.group(), False))
            at = m.end()
    return out


def diff_runs(before: str, after: str) -> list[tuple[str, str]]:
    """(same | removed | added, text) runs over words, Han characters and single others; both sides are rebuilt exactly."""
    cut = re.compile(r"[A-Za-z0-9]+|\s+|.", re.S)
    a, b = cut.findall(before), cut.findall(after)
    if len(a) * len(b) > MOST_CELLS:
        whole = [("same", before)] if before == after else [("removed", before), ("added", after)]
        return [(k, t) for k, t in whole if t]
    out: list[tuple[str, str]] = []
    for op, i, j, x, y in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for kind, own in (("same", a[i:j] if op == "equal" else []), ("removed", [] if op == "equal" else a[i:j]), ("added", [] if op == "equal" else b[x:y])):
            if own:
                out.append((kind, "".join(own)))
    return out


def similarity(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _classes() -> dict[str, re.Pattern]:
    """Each class as one pattern over both languages; their scripts keep them apart."""
    names = dict.fromkeys([*M.ZH, *M.EN])
    return {k: re.compile("|".join([*([M.ZH[k]] if k in M.ZH else []), *([f"(?i:{M.EN[k]})"] if k in M.EN else [])])) for k in names}


MARKERS = _classes()
_TOGETHER, _CAUSING = re.compile(M.TOGETHER), re.compile(M.CAUSING)
_SIGNED = re.compile(f"{M.COMPARATOR}|{M.EQUATION}")
NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?%?|[〇零一二三四五六七八九十百千万亿]{2,}")
CITATION = re.compile(r"\[\d+(?:[,，\-–]\s*\d+)*\]|[(（][A-Z][A-Za-z]+(?: et al\.?)?,?\s*\d{4}[a-z]?[)）]")
NAME = re.compile(r"[A-Z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*")
_PHRASES = {p: sign for sign, phrases in M.BOUNDS.items() for p in phrases}
_BOUND = re.compile(r"(?i)(?:\b(?=[a-z])|(?=[^a-z]))(" + "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in sorted(_PHRASES, key=len, reverse=True)) + r")\s*[+\-−]?\d")


def bounds(text: str) -> list[str]:
    """Signs of the bounds before numbers, in order; a longer phrase hides the shorter ones inside it."""
    return [_PHRASES[" ".join(m[1].lower().split())] for m in _BOUND.finditer(text)]


def profile(text: str) -> dict[str, Counter]:
    rest = _BOUND.sub(lambda m: " " * len(m.group()), text)  # words of bounds are no words of a class
    got = {k: Counter(m.group().lower() for m in p.finditer(rest)) for k, p in MARKERS.items()}
    plain = [re.sub(r"\s+", "", m.group()) for m in _SIGNED.finditer(text)]
    return got | {"number": Counter(NUMBER.findall(text)), "citation": Counter(CITATION.findall(text)), "name": Counter(NAME.findall(text)), "bounds": Counter(bounds(text)), "signs": Counter(plain)}


def compare(source: str, output: str) -> dict[str, list[str]]:
    """Facts that ``output`` adds or loses, and the classes of meaning whose counts changed; empty lists: nothing did."""
    a, b = profile(source), profile(output)
    facts = ("number", "citation", "name")
    new, gone = ([f"{k}:{x}" for k in facts for x in y[k].keys() - x_[k].keys()] for x_, y in ((a, b), (b, a)))
    changed = {k for k in MARKERS if a[k].total() != b[k].total()} | {k for k in ("bounds", "signs") if a[k] != b[k]}
    found = lambda p, t: len(p.findall(t))
    stronger = found(_CAUSING, output) > found(_CAUSING, source) and found(_TOGETHER, output) < found(_TOGETHER, source)
    return {"added": sorted(new), "removed": sorted(gone), "semantic": sorted(changed) + ["correlation->causation"] * stronger}


def clauses(text: str) -> list[str]:
    return [c.strip() for c in re.split(r"[，；。！？\n]|[,;!?]|\.(?=\s|$)", text) if c.strip()]


def align(source: str, output: str, window: int = 6) -> list[tuple[int, int, float]]:
    """(clause, best clause, score): each source clause and the most similar within ``window`` of its projected place."""
    a, b = clauses(source), clauses(output)
    out = []
    for i, x in enumerate(a):
        at = round(i * (len(b) - 1) / (len(a) - 1)) if len(a) > 1 else 0
        near = range(max(0, at - window), min(len(b), at + window + 1))
        names = set(NAME.findall(x))
        scored = [(similarity(x, b[j]) + len(names & (n := set(NAME.findall(b[j])))) / max(1, len(names | n)), -j) for j in near]
        if scored:
            best, j = max(scored)
            out.append((i, -j, best))
    return out


def candidate_score(source: str, candidate: str, drop: int) -> float:
    """Gates as negative scores (empty, length outside 0.55 to 1.45, facts changed), else findings dropped and likeness."""
    if not candidate.strip():
        return -9000.0
    if not 0.55 <= len(candidate) / max(1, len(source)) <= 1.45:
        return -8800.0
    changed = compare(source, candidate)
    if changed["added"] or changed["removed"]:
        return -8500.0
    return -8400.0 if changed["semantic"] else drop * 8 + similarity(source, candidate) * 2


def pick(source: str, candidates: list[str], drops: list[int]) -> int | None:
    """The first best candidate that passes every gate; None if none does."""
    best = max(range(len(candidates)), key=lambda i: (candidate_score(source, candidates[i], drops[i]), -i), default=None)
    return best if best is not None and candidate_score(source, candidates[best], drops[best]) > 0 else None


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TEXTS = T.ArrayType(T.StringType())
UNITS = _struct(**dict.fromkeys(("words", "han", "other", "total"), T.LongType()))


@F.arrow_udf(UNITS)
def billable_units_udf(text: pa.Array) -> pa.Array:
    parts = [units_of([t or "" for t in text.slice(i, HELD).to_pylist()]) for i in range(0, max(1, len(text)), HELD)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(parts, axis=1)], names=UNITS.names)


@F.pandas_udf(T.LongType())
def visible_chars_udf(text: pd.Series) -> pd.Series:
    return pd.Series([visible_chars(t or "") for t in text], dtype="int64")


@F.pandas_udf(T.ArrayType(_struct(text=T.StringType(), editable=T.BooleanType())))
def chunks_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"text": x, "editable": e} for x, e in chunks(t or "")])


RUN = pa.struct([("kind", pa.string()), ("text", pa.string())])


@F.arrow_udf(T.ArrayType(_struct(kind=T.StringType(), text=T.StringType())))
def diff_runs_udf(before: pa.Array, after: pa.Array) -> pa.Array:
    out = []
    for i in range(0, max(1, len(before)), HELD):
        own = zip(before.slice(i, HELD).to_pylist(), after.slice(i, HELD).to_pylist(), strict=True)
        out.append(pa.array([[{"kind": k, "text": t} for k, t in diff_runs(a or "", b or "")] for a, b in own], pa.list_(RUN)))
    return pa.concat_arrays(out)


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(_struct(added=TEXTS, removed=TEXTS, semantic=TEXTS))
def compare_udf(source: pd.Series, output: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compare(a or "", b or "") for a, b in zip(source, output, strict=True)], columns=["added", "removed", "semantic"])


def register(spark) -> None:
    """The scalar functions for SQL."""
    for name, udf in (("visible_chars", visible_chars_udf), ("billable_units", billable_units_udf), ("similarity_ratio", similarity_udf)):
        spark.udf.register(name, udf)
