"""All rules over whole texts in one pass: a findings table, from which scores and violations are aggregated.

Many patterns with offsets over one text are the case where one Arrow pass beats a scan for each pattern.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import rules as T

Hit = tuple[int, int]
_HAN = re.compile("[一-鿿]")
_LATIN = re.compile("[A-Za-z]")
_PROSE_ZH = re.compile("[，。！？；]|本文|本研究|研究|方法|结果|分析|探讨")
# How items of a list are written, and words that end none.
_CLAUSE = re.compile(r"[^，。；：！？\n]+")
_JOINED = re.compile("[且和以及与并]")
_THREE = re.compile(r"\b(\w+(?:\s\w+){0,2}),\s(\w+(?:\s\w+){0,2}),\s+and\s(\w+(?:\s\w+){0,2})\b")
_LAST = re.compile(r",\s+and\s")
_ENDING = re.compile(r"(?:\s(?:for|in|on|to|with|of|at|by|from|and|or|as|that|which|who|when|while))+$", re.I)


def language(text: str) -> str:
    zh, en = len(_HAN.findall(text)), len(_LATIN.findall(text))
    if not zh + en or (zh >= 4 and _PROSE_ZH.search(text)):
        return "zh"
    return "zh" if zh > 0.30 * (zh + en) else "en"


def spans(text: str, pattern: str) -> Iterator[Hit]:
    """Stripped, non-blank pieces between matches of a separator, with offsets."""
    at = 0
    for m in [*re.finditer(pattern, text), None]:
        piece = text[at : m.start() if m else len(text)]
        if piece.strip():
            lead = len(piece) - len(piece.lstrip())
            yield at + lead, at + lead + len(piece.strip())
        at = m.end() if m else at


def sentences(text: str, lang: str) -> Iterator[Hit]:
    return spans(text, r"(?<=[.!?])\s+" if lang == "en" else r"(?<=[。！？；])|\n")


def items_zh(clause: str) -> list[str]:
    """What a clause lists; its last item is two if one joining character stands between two short halves."""
    *items, last = clause.split("、")
    halves = _JOINED.split(last)
    if items and len(halves) == 2 and all(2 <= len(h) <= 12 for h in halves):
        items += halves
    else:
        items.append(last)
    return [x for x in items if x]


def parallel_items(text: str) -> Iterator[Hit]:
    """Clauses of three items at least, alike in length; the first may be longer, since it often carries the verb."""
    for m in _CLAUSE.finditer(text):
        if "、" in m.group():
            first, *others = map(len, items_zh(m.group()) or [""])
            if len(others) >= 2 and (shortest := min(others)) >= max(others) - 2 and first >= shortest:
                yield m.span()


def lowered(text: str) -> str:
    """The text with each letter in lower case by itself; letters whose lower case is several stay."""
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:  # a sigma depends on what stands around it
        return low
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Terms:
    """All places of many terms in a text, in one pass; ``words``: only between word bounds, upper case like lower case."""

    def __init__(self, terms: list[str], words: bool):
        self.words, self.tree = words, ahocorasick.Automaton()
        for t in terms:
            self.tree.add_word(t.lower() if words else t, len(t))
        self.tree.make_automaton()

    def find(self, text: str) -> Iterator[Hit]:
        low = lowered(text) if self.words else text
        inside = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        for last, size in self.tree.iter(low):
            start, end = last + 1 - size, last + 1
            if not self.words or (inside(start - 1) != inside(start) and inside(end - 1) != inside(end)):
                yield start, end


def stacked(terms: list[str], words: bool) -> Callable[[str], Iterator[Hit]]:
    """From the first to the last of two hits or more."""
    own = re.compile("|".join(map(re.escape, terms)), re.I if words else 0)
    every = [re.compile(re.escape(t), re.I if words else 0) for t in terms]

    def find(text: str) -> Iterator[Hit]:
        if own.search(text):
            hits = sorted(m.span() for p in every for m in p.finditer(text))
            if len(hits) > 1:
                yield hits[0][0], hits[-1][1]

    return find


def ordinal_headings(text: str) -> list[Hit]:
    """Short lines that begin with an ordinal and end no sentence; three of them at least."""
    mark = re.compile(r"[^\S\n]*(?:#{1,6}\s*)?(?:\*\*)?\s*(?:[一二三四五六七八九十]+[、.]|第[一二三四五六七八九十]+[、,，.]?)")
    out, at = [], 0
    for line in text.split("\n"):
        m, own = mark.match(line), line.strip()
        if m and len(own) <= 30 and own[-1:] not in "。！？":
            out.append((at, at + m.end()))
        at += len(line) + 1
    return out if len(out) >= 3 else []


def rule_of_three(text: str) -> Iterator[Hit]:
    """``a, b, and c`` of like length in words; what only leads on from c is not counted, and lists of names are none."""
    for m in _THREE.finditer(text) if _LAST.search(text) else ():
        third = _ENDING.sub("", m[3])
        sizes = [len(x.split()) for x in (m[1], m[2], third)]
        named = m[2][0].isupper() and third[0].isupper()
        if not named and abs(sizes[1] - sizes[2]) < 2 and sizes[0] >= min(sizes[1:]):
            yield m.start(), m.start(3) + len(third)


FINDERS: dict[str, Callable[[str], Iterator[Hit] | list[Hit]]] = {
    "parallel_items": parallel_items,
    "ordinal_headings": ordinal_headings,
    "rule_of_three": rule_of_three,
    "hedges_zh": stacked(L.HEDGES_ZH, False),
    "hedges_en": stacked(L.HEDGES_EN, True),
}


def finder(pattern: str) -> Callable[[str], Iterator[Hit] | list[Hit]]:
    if pattern.startswith("="):
        return FINDERS[pattern[1:]]
    p = re.compile(pattern)
    return lambda text: (m.span() for m in p.finditer(text))


class Vocabulary:
    """Terms of tiers 1 and 2 in a sentence; a hit inside a longer or earlier one is none."""

    def __init__(self, lang: str):
        self.of = {t.lower(): (tier, w) for t, tier, w in L.terms(lang) if tier != "T3"}
        self.terms = Terms(list(self.of), lang == "en")

    def find(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        reach = -1
        for start, end in sorted(self.terms.find(text), key=lambda h: (h[0], -h[1])):
            if end > reach:
                reach = end
                yield (start, end, *self.of[text[start:end].lower()])


#: What a text must hold, one of each, in lower case for English, for a rule to match anywhere in it (key: language and rule).
_RULES_NEED = {
    ("en", "S03"): ("not just", "not only", "not merely", "not simply", "it's not", "it is not", "it was not", "it not", "rather than"),
    ("en", "S04"): (" as", "represent", "boast", "refers to"), ("en", "S05"): ("ing",), ("en", "S08"): (" role", "testament", "underscor", "highlight", "mark", "paving the way", "open"),
    ("en", "S07"): ("argue", "suggest", "note", "contend", "have cited", "have argued", "believe", "point out", "show", "indicate", "accepted", "acknowledged"),
    ("en", "S09"): tuple(L.HEDGES_EN), ("en", "S11"): ("it was", "it is", "it has been", "it should be", "it must be", "it can be"), ("en", "S12"): ("according to",), ("en", "S02"): ("first", "on the one hand"),
    ("en", "P02"): ("in conclusion", "in summary", "overall", "taken together", "in essence"), ("en", "P03"): ("despite", "challenges", "future"),
}


def _possible(text: str, kit: dict) -> dict:
    """The kit's rules that may match in a text: looking for what they need is far cheaper than each rule in each sentence."""
    low = text.lower().replace("ſ", "s").replace("ı", "i").replace("i\u0307", "i")  # what patterns hold for the same letter
    han = _HAN.search(text) is not None

    def may(rule: T.Rule) -> bool:
        if rule.lang == "zh" and rule.scope != "document" and not rule.pattern.startswith("="):
            return han  # all of them name Han characters
        return any(x in low for x in _RULES_NEED.get((rule.lang, rule.rule), ("",)))

    return {k: [x for x in kit[k] if may(x[0])] for k in kit if k[0] != "vocabulary"}


def diagnose_text(text: str, kit: dict) -> list[tuple]:
    """(rule, lang, severity, weight, handling, para, sent, start, end, matched) of one text, by start."""
    out, langs, able = [], [], _possible(text, kit)
    paras = list(spans(text, "\n"))
    for pi, (a, b) in enumerate(paras):
        lang = language(text[a:b])
        langs.append(lang)
        for si, (s, e) in enumerate(sentences(text[a:b], lang)):
            own = text[a + s : a + e]
            for x, y, tier, weight in kit["vocabulary", lang].find(own):
                out.append((f"V-{tier}", lang, {"T1": "high", "T2": "medium"}[tier], weight, "", pi, si, a + s + x, a + s + y))
            for rule, find in able["sentence", lang]:
                out += [(rule.rule, lang, rule.severity, rule.weight, rule.handling, pi, si, a + s + x, a + s + y) for x, y in find(own)]
        for rule, find in able["paragraph", lang]:
            out += [(rule.rule, lang, rule.severity, rule.weight, rule.handling, pi, None, a + x, a + y) for x, y in find(text[a:b])]
    starts = [a for a, _ in paras]
    for rule, find in able["document", "zh"]:
        for x, y in find(text):
            pi = bisect_right(starts, x) - 1
            out.append((rule.rule, langs[pi] if pi >= 0 and y <= paras[pi][1] else "zh", rule.severity, rule.weight, rule.handling, -1, None, x, y))
    return sorted(((*f, text[f[7] : f[8]]) for f in out), key=lambda f: (f[7], f[8], f[0]))


def toolkit() -> dict:
    kit: dict = {("vocabulary", lang): Vocabulary(lang) for lang in ("zh", "en")}
    for scope in ("sentence", "paragraph", "document"):
        for lang in ("zh", "en"):
            kit[scope, lang] = [(r, finder(r.pattern)) for r in [*T.ZH, *T.EN, *T.FORMAT] if (r.scope, r.lang) == (scope, lang)]
    return kit


FINDING = "rule string, lang string, severity string, weight double, handling string, para int, sent int, start int, end int, matched string"


def _per_text(key: str, columns: list[str], work: Callable[[str], list[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *f) for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if t.is_valid for f in work(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip([key, *columns], r, strict=True)) for r in rows])

    return run


def diagnose(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The findings of every text: ``doc_id`` and FINDING. Null and empty texts have none."""
    held: list[dict] = []

    def work(text: str) -> list[tuple]:
        if not held:
            held.append(toolkit())
        return diagnose_text(text, held[0])

    kind = docs.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in FINDING.split(", ")]
    return docs.select(key, "text").mapInArrow(_cast(_per_text(key, names, work), f"{key} {kind}, {FINDING}"), f"{key} {kind}, {FINDING}")


def _cast(run, schema: str):
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64()}
    want = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in want], schema=want)

    return cast


def scores(found: DataFrame, paras: DataFrame) -> DataFrame:
    """Kinds of rules (one more above the vocabulary limit), vocabulary hits, weighted sum and level by paragraph."""
    per = found.where("para >= 0").groupBy("doc_id", "para").agg(
        F.array_sort(F.collect_set("rule")).alias("hit_rules"), F.count_if(F.col("rule").startswith("V-")).alias("vocab_hits"), F.sum("weight").alias("w")
    )
    both = paras.select("doc_id", "para").join(per, ["doc_id", "para"], "left").fillna(0, ["vocab_hits"]).fillna(0.0, ["w"])
    raw = F.coalesce(F.size("hit_rules"), F.lit(0)) + F.when(F.col("vocab_hits") > L.PARAGRAPH_LIMIT, 1).otherwise(0)
    both = both.withColumn("raw_score", F.when(F.col("hit_rules").isNull(), 0).otherwise(raw))
    level = F.when(F.col("raw_score") >= 4, "high").when(F.col("raw_score") >= 2, "medium").otherwise("low")
    return both.select("doc_id", "para", F.coalesce("hit_rules", F.array().cast("array<string>")).alias("hit_rules"), "vocab_hits", "raw_score", F.bround("w", 2).alias("weighted"), level.alias("level"))


def violations(found: DataFrame, scored: DataFrame) -> DataFrame:
    """``doc_id, rule, para, actual, limit`` of hard limits by document, share of paragraphs and vocabulary."""
    limit = F.coalesce(*[F.when(F.col("rule") == k, F.lit(float(v))) for k, v in T.DOCUMENT_LIMITS.items()])
    count = found.groupBy("doc_id", "rule").agg(F.count("*").cast("double").alias("actual")).withColumn("limit", limit).where("actual > limit")
    n = scored.groupBy("doc_id").agg(F.count("*").alias("n"))
    share = F.coalesce(*[F.when(F.col("rule") == k, F.lit(float(v))) for k, v in T.SHARE_LIMITS.items()])
    hit = found.where(F.col("rule").isin(list(T.SHARE_LIMITS))).groupBy("doc_id", "rule").agg(F.count_distinct("para").alias("k")).join(n, "doc_id")
    by_share = hit.select("doc_id", "rule", (F.col("k") / F.col("n")).alias("actual"), share.alias("limit")).where("actual > limit")
    words = scored.where(F.col("vocab_hits") > L.PARAGRAPH_LIMIT).select("doc_id", F.lit("V-LIMIT").alias("rule"), "para", F.col("vocab_hits").cast("double").alias("actual"), F.lit(float(L.PARAGRAPH_LIMIT)).alias("limit"))
    return count.unionByName(by_share).withColumn("para", F.lit(None).cast("int")).unionByName(words)


# --- the 31-check policy -------------------------------------------------------------------------------------------

# Spans that no check looks into and no edit touches.
_PROTECTED = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{([A-Za-z*]+)\}.*?\\end\{\1\}|(?i:<(code|pre)\b[^>]*>.*?</\2\s*>)"
    r"|`[^`\n]+`|\$[^$\n]+\$|(?m:^(?: {4}|\t)[^\n]*$)",
    re.S,
)
_FULL = re.compile(r"[^\n。！？]+[。！？]?|\n")
_SILENT = re.compile(r"[\s。！？]")
_OPENING = re.compile(r"^[\s“‘\"']+")
_PASSIVE = r"被[^\n，。！？]{1,30}+"
#: Stacks of passives in a line, from the first to the last.
_STACKS = [(check, re.compile(rf"{_PASSIVE}(?>[^\n]*?{_PASSIVE}){{{more},}}")) for check, more in (("B11", 1), ("F28", 2))]


#: What a text must hold, one of each, for a check's pattern to match at all; looking for it is far cheaper than the pattern.
_NEEDED = {
    "A1": ("不仅", "不是"), "A3": ("的语言", "的镜子", "的桥梁", "的钥匙", "的密码"), "A4": ("让我们", "是你需要知道的"), "A5": ("误会", "的是"), "B6": ("、",), "B8": ("——", "--"),
    "B10": ("-", "—"), "C13": ("标志着", "象征着"), "C14": ("联系",), "C15": ("彰显了", "凸显了", "体现了", "展现了"), "C16": ("堪称", "性地"), "C17": ("认为", "表明"), "C18": ("作为", "发挥"),
    "D19": ("**",), "D21": ('"',), "E22": ("好问题", "很高兴", "希望这"), "E23": ("有限",), "E25": ("这一段是", "上一稿"), "F26": ("的",), "F27": ("进行",), "F29": ("、", ",", "，"),
    "F30": ("背景下",), "F31": ("拭目以待", "共同期待"),
}
#: Patterns that are looked for in place of a check's own, with the same matches: one whose match begins where a sentence does is tried nowhere else.
_INSTEAD = {"B8": r"(?<![^\n。！？])" + next(c.pattern for c in T.POLICY if c.check == "B8")}
_LOOKED_FOR = [(c.check, re.compile(_INSTEAD.get(c.check, c.pattern)), _NEEDED.get(c.check)) for c in T.POLICY if c.pattern]


def policy_matches(text: str) -> Iterator[tuple[str, re.Match]]:
    """(check, match) of every check that is a pattern."""
    for check, own, needed in _LOOKED_FOR:
        if needed is None or any(x in text for x in needed):
            for m in own.finditer(text):
                yield check, m


def _sentence_checks(text: str) -> Iterator[tuple[str, int, int]]:
    """Runs of three sentences that are short or open alike, found as runs in a line of one sign for each sentence; and hedges in one."""
    sents = [m.span() for m in _FULL.finditer(text) if not m.group().isspace()]
    own = [text[a:b] for a, b in sents]
    short = "".join("s" if len(_SILENT.sub("", x)) <= 8 else "." for x in own)
    heads = [_OPENING.sub("", x.strip())[:2] for x in own]
    alike = "".join("=" if x and x == y else "." for x, y in zip(heads, heads[1:], strict=False))
    for check, signs, run in (("A2", short, "(?=sss)"), ("B7", alike, "(?===)")):
        for m in re.finditer(run, signs):
            yield check, sents[m.start()][0], sents[m.start() + 2][1]
    for span, x in zip(sents, own, strict=True):
        if sum(map(x.count, L.HEDGES_ZH)) > 1 and sum(h in x for h in L.HEDGES_ZH) > 1:
            yield "B9", *span


def _title_echo(text: str) -> Iterator[tuple[str, int, int]]:
    """A title of 3 to 32 characters that the next line begins with and goes on from."""
    first = re.search(r"[^\n]*\S[^\n]*", text)
    second = first and re.compile(r"[^\n]*\S[^\n]*").search(text, first.end())
    if second and first.group().rstrip()[-1] not in "。！？":
        title = first.group().strip().lstrip("#").strip().strip(" ：:。！？")
        line = second.group().strip()
        if 2 < len(title) < 33 and line != title and line.startswith(title):
            yield "E24", second.start(), min(second.end(), second.start() + len(title))


_CHECKS = {c.check: c for c in T.POLICY}


def _template(new: str) -> Callable[[re.Match], str]:
    """A replacement that expands to nothing where it names groups and none took part."""
    return lambda m: m.expand(new) if m.lastindex or "\\" not in new else ""


#: What each check that can replace its match makes of it.
REPLACE: dict[str, Callable[[re.Match], str]] = {
    c.check: (lambda m: T.WORDS_C12.get(m.group(), m.group())) if c.replace == "=words" else _template(c.replace) for c in T.POLICY if c.replace is not None
}


def policy_text(text: str) -> list[tuple]:
    """(check, severity, handling, start, end, matched, replacement) outside code and formulas, each span once, by start."""
    kept = [m.span() for m in _PROTECTED.finditer(text)]
    by = _CHECKS
    hits: dict[tuple, str | None] = {}
    for check, m in policy_matches(text):
        hits.setdefault((m.start(), m.end(), check), REPLACE[check](m) if check in REPLACE else None)
    stacks = ((check, *m.span()) for check, p in _STACKS for m in p.finditer(text))
    for check, a, b in chain(_sentence_checks(text), _title_echo(text), stacks):
        hits.setdefault((a, b, check), None)
    ends = [e for _, e in kept]
    clear = lambda a, b: (i := bisect_right(ends, a)) == len(kept) or b <= kept[i][0]
    free = [k for k in hits if k[0] < k[1] and clear(k[0], k[1])]
    return [(k[2], by[k[2]].severity, by[k[2]].handling, k[0], k[1], text[k[0] : k[1]], hits[k]) for k in sorted(free)]


POLICY_FINDING = "check string, severity string, handling string, start int, end int, matched string, replacement string"


def policy(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The findings of the 31 checks over whole texts: ``doc_id`` and POLICY_FINDING."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {POLICY_FINDING}"
    names = [c.split()[0] for c in POLICY_FINDING.split(", ")]
    return docs.select(key, "text").mapInArrow(_cast(_per_text(key, names, policy_text), schema), schema)


def apply_safe(text: str, found: list[tuple]) -> str:
    """The safe replacements, from the right; one that overlaps a later one is left out."""
    last = len(text) + 1
    for check, _, handling, start, end, _, new in sorted(found, key=lambda f: (-f[3], f[0])):
        if handling == "safe" and new is not None and end <= last:
            text, last = text[:start] + new + text[end:], start
    return text
