"""Drafts on their way: packing and rebuilding texts, cleaning a model's output, checking what a rewrite changed, asking a model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import diagnose as D
from . import edits as E
from . import prose as P
from . import review as V

# Words of lines in which a model speaks about its output, quotes and tags that wrap it.
META_ZH = ["以下是", "如下所示", "如下：", "改写后", "改写方向", "修改说明", "已按要求", "如需调整", "请告知", "希望对", "好的，", "当然，", "注：", "说明：", "以上为", "本次改写"]
META_EN = ["here is", "here's", "here are", "rewritten version", "i've rewritten", "let me know", "hope this", "as requested", "note:", "revised version"]
META_MOST = 80
OPENING, CLOSING = "「“\"'", "」”\"'"
TAGS = "output|text|result|rewritten|answer"
# How long a rewrite may be against its source, and how like sentences count as kept or moved.
LEGACY_LENGTH, WHOLE_LENGTH = (0.70, 1.35), 0.4
KEPT, MOVED = 0.72, 0.82
PACK = 6000


# --- texts in parts --------------------------------------------------------------------------------------------------------


def pack(paragraphs: list[str], most: int = PACK) -> list[str]:
    """Neighbouring paragraphs joined by blank lines, as many as ``most`` characters hold; a longer one stands alone."""
    out: list[list[str]] = []
    size = 0
    for p in paragraphs:
        if out and size + len(p) <= most:
            out[-1].append(p)
            size += 2 + len(p)
        else:
            out.append([p])
            size = len(p)
    return ["\n\n".join(x) for x in out]


def packed(text: Column, most: int = PACK) -> Column:
    """The packs of a text's paragraphs; a text without any is one pack."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else pack([p for _, _, p in X.line_spans(t)], most) or [t] for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)


def rebuilt(text: Column, edits: Column) -> Column:
    """The text with some paragraphs (map of place to new text) replaced; white space around them stays."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, maps: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), maps.to_pylist(), strict=True):
            if t is not None and own:
                new, parts, last = dict(own), [], 0
                for i, (start, end, _) in enumerate(X.line_spans(t)):
                    if i in new:
                        parts += [t[last:start], new[i]]
                        last = end
                t = "".join([*parts, t[last:]])
            out.append(t)
        return pa.array(out, pa.string())

    return run(text, edits)


def with_source_breaks(source: Column, output: Column) -> Column:
    """The output with the source's line breaks if both have as many, none of them alone different, and no part is blank."""
    own, new = F.regexp_extract_all(source, F.lit(r"\n+"), F.lit(0)), F.regexp_extract_all(output, F.lit(r"\n+"), F.lit(0))
    parts = F.split(output, r"\n+", -1)
    blank = F.exists(F.concat(parts, F.split(source, r"\n+", -1)), lambda p: F.length(X.strip(p)) == 0)
    joined = F.array_join(F.zip_with(parts, F.concat(own, F.array(F.lit(""))), lambda p, b: F.concat(p, b)), "")
    return F.when((F.size(own) > 0) & (F.size(own) == F.size(new)) & (own != new) & ~blank, joined).otherwise(output)


def tidy_en(text: Column) -> Column:
    """English after deletions: no blanks before marks, no doubled marks or blanks, capitals where a sentence begins.

    A capital is one letter: ß has its own, and letters whose upper case is several stay.
    """
    t = F.regexp_replace(text, r"\s+([.,;:!?])", "$1")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"([.,;:])(?:\s*\1)+", "$1"), r"\s+", " "))
    letter = lambda x: F.when(x == "ß", "\u1e9e").when(F.length(F.upper(x)) > 1, x).otherwise(F.upper(x))
    capital = lambda x: F.concat(letter(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))
    bullet = F.regexp_extract(t, r"^(?:(?:[-*•]|[0-9]+[.)])\s)?", 0)
    body = F.split(F.substr(t, F.length(bullet) + 1), r"(?<=[.!?]\s)(?=[a-z])", -1)
    return F.concat(bullet, F.array_join(F.transform(body, capital), ""))


def plain_base(text: Column) -> Column:
    """A generated text without fences, heading lines, bold marks and rows of blank lines."""
    t = F.regexp_replace(F.trim(text), r"(?m)^```[a-zA-Z]*\n?|```$", "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: ~F.ltrim(x).startswith("#"))
    t = F.regexp_replace(F.array_join(lines, "\n"), r"\*\*(.+?)\*\*", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def cleaned_output(raw: Column) -> Column:
    """A model's output without fence, wrapping tag, lines at either end that speak about it, and quotes around the whole."""
    t = F.regexp_replace(X.strip(raw), r"(?m)^[ \t]*```[a-zA-Z0-9_-]*[ \t]*$", "")
    t = X.strip(F.regexp_replace(X.strip(t), rf"(?is)^<({TAGS})>(.*)</\1>$", "$2"))
    lines = F.split(t, "\n", -1)
    says = lambda x, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w))
    about = lambda x: (F.length(x) <= META_MOST) & (F.length(X.strip(x)) > 0) & (says(x, META_ZH) | says(F.lower(x), META_EN))
    aside = lambda x: about(x) | (F.length(X.strip(x)) == 0) | x.rlike(r"^\s*[（(].{0,80}[）)]\s*$")
    first = F.array_position(F.transform(lines, lambda x: about(x) | (F.length(X.strip(x)) == 0)), F.lit(False))
    last = F.size(lines) + 1 - F.array_position(F.transform(F.reverse(lines), aside), F.lit(False))
    kept = F.when((first == 0) | (last > F.size(lines)) | (last < first), F.slice(lines, -1, 1)).otherwise(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(1))))
    t = X.strip(F.array_join(kept, "\n"))
    wrapped = (F.length(t) > 2) & F.contains(F.lit(OPENING), F.substring(t, 1, 1)) & F.contains(F.lit(CLOSING), F.substring(t, -1, 1))
    return F.when(wrapped, X.strip(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def typical_width(lines: Column) -> Column:
    """The upper median of a page's line lengths, blank lines left out."""
    sizes = F.filter(F.transform(lines, lambda x: F.length(X.strip(x))), lambda n: n > 0)
    return F.get(F.sort_array(sizes), F.floor(F.size(sizes) / 2).cast("int"))


# --- what a rewrite changed --------------------------------------------------------------------------------------------------


def _units(paragraph: str) -> list[str]:
    """Sentences of six letters or more, by letters and digits alone."""
    bare = (re.sub(r"[^一-鿿a-z0-9]", "", s.lower()) for s in re.findall(r"[^\n。！？!?]+", paragraph))
    return [x for x in bare if len(x) >= 6]


def moved_sentences(source: list[str], output: list[str]) -> list[tuple[int, str]]:
    """(paragraph, sentence) of sentences that one paragraph alone had, which it lost and another one has."""
    before, after = [_units(p) for p in source], [_units(p) for p in output]
    owners: dict[str, set[int]] = {}
    for i, units in enumerate(before):
        for u in units:
            owners.setdefault(u, set()).add(i)
    like = lambda a, b: SequenceMatcher(None, a, b).ratio()
    out = []
    for i, units in enumerate(before):
        here = after[i] if i < len(after) else []
        for u in units:
            if len(owners[u]) == 1 and u not in here and not any(like(u, x) >= KEPT for x in here):
                there = (x for k, other in enumerate(after) if k != i for x in other)
                if any(u in x or x in u or like(u, x) >= MOVED for x in there):
                    out.append((i, u))
    return out


def paragraph_safety(source: str, output: str) -> tuple[int, str]:
    """(code, reason) of the first thing that makes paragraphs unsafe to write back in place; (0, "") if there is none."""
    if re.findall(r"\n+", source) != re.findall(r"\n+", output):
        return -8500, "line breaks"
    a, b = (re.split(r"\n+", t) for t in (source, output))
    if moved := moved_sentences(a, b):
        return -8475, f"a sentence left paragraph {moved[0][0] + 1}"
    kept = lambda t: [m.group() for m in D._PROTECTED.finditer(t)]
    for i, (x, y) in enumerate(zip(a, b, strict=True), 1):
        if x != y:
            changed = E.compare(x, y)
            for code, bad, why in (
                (-8450, bool(x.strip()) != bool(y.strip()), "emptied or filled"),
                (-8400, kept(x) != kept(y), "code or formulas"),
                (-8300, bool(changed["added"] or changed["removed"] or changed["semantic"]), "facts"),
            ):
                if bad:
                    return code, f"paragraph {i}: {why}"
    return 0, ""


def local_changes(source: str, output: str) -> list[tuple[str, str, list[str]]]:
    """(clause, its counterpart, reasons) of source clauses with facts whose counterpart binds them otherwise."""
    b, out = E.clauses(output), []
    own = E.clauses(source)
    for i, j, score in E.align(source, output) or [(i, None, 0.0) for i in range(len(own))]:
        x, y = own[i], b[j] if j is not None else ""
        p, q = E.profile(x), E.profile(y)
        if not any(p.values()):
            continue
        reasons = ["missing"] if not y else ["not aligned"] if score < 0.35 else []
        if y:
            reasons += [f"{k} bound otherwise" for k in ("number", "citation", "name", "bounds") if p[k] != q[k]]
            reasons += [f"{k} changed" for k in E.MARKERS if sum(p[k].values()) != sum(q[k].values())]
            words, others = re.findall(r"\w+", x.lower()), re.findall(r"\w+", y.lower())
            reasons += ["order changed"] if words != others and sorted(words) == sorted(others) else []
        if reasons:
            out.append((x, y, reasons))
    return out


def document_guard(source: str, output: str) -> dict:
    """The guard of a whole document: facts, meaning, bindings by clause, and Latin words inside Chinese text."""
    latin = lambda t: sorted(re.findall(r"[A-Za-z][A-Za-z0-9_-]*", t)) if D._HAN.search(t) else []
    out = E.compare(source, output)
    bound = [r for _, _, reasons in local_changes(source, output) for r in reasons]
    return out | {"latin": latin(source) != latin(output), "bindings": sorted(set(bound)), "blocked": bool(out["added"] or out["removed"] or out["semantic"] or bound or latin(source) != latin(output))}


def autofix_bilingual(text: str) -> tuple[str, int]:
    """The safe replacements of a text of either or both languages, under the guard of the whole document; the text itself if that objects."""
    from . import autofix

    out, n = autofix.autofix(text)
    return (text, 0) if n and document_guard(text, out)["latin"] else (out, n)


def legacy_score(source: Column, candidate: Column, before: Column, after: Column, report_only: list[str]) -> Column:
    """Weight that a candidate takes away, less one and a half for each new rule and a share of its change in length; -9000 if it is empty,
    -8800 if its length is out of bounds. ``before`` and ``after`` are maps of rule to weight."""
    share = F.length(candidate) / F.greatest(F.length(source), F.lit(1))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)
    fresh = F.size(F.array_except(F.array_except(F.map_keys(after), F.map_keys(before)), F.array(*[F.lit(r) for r in report_only]).cast("array<string>")))
    score = total(before) - total(after) - fresh * 1.5 - F.abs(share - 1)
    return F.when(F.length(F.trim(candidate)) == 0, F.lit(-9000.0)).when(~share.between(*LEGACY_LENGTH), F.lit(-8800.0)).otherwise(score)


def whole_variant(source: Column, output: Column) -> Column:
    """A whole document's rewrite, or the source if that is less than 0.4 of it."""
    return F.when(F.length(F.coalesce(output, F.lit(""))) < F.length(source) * WHOLE_LENGTH, source).otherwise(output)


def clause_profiles(docs: DataFrame) -> DataFrame:
    """``doc_id, clause, text, numbers, citations, names, skeleton``: each clause's facts in order, and the clause with its facts blanked."""
    own = F.filter(F.transform(F.split("text", r"[，；。！？\n]|[,;!?]|\.(?=\s|$)", -1), X.strip), lambda c: F.length(c) > 0)
    every = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    skeleton = F.lower(F.regexp_replace(F.regexp_replace("text", E.CITATION.pattern, "@"), E.NUMBER.pattern, "#"))
    out = docs.select("doc_id", F.posexplode(own).alias("clause", "text"))
    return out.select("doc_id", "clause", "text", every(E.NUMBER.pattern).alias("numbers"), every(E.CITATION.pattern).alias("citations"), every(E.NAME.pattern).alias("names"), skeleton.alias("skeleton"))


def best_candidates(scored: DataFrame) -> DataFrame:
    """Of each paragraph's candidates ``doc_id, para, candidate, score, verified`` the first best one, if it passes every gate (a score above 0)."""
    best = F.max_by(F.struct("candidate", "score", "verified"), F.struct("score", -F.col("candidate"))).alias("b")
    out = scored.groupBy("doc_id", "para").agg(F.count("*").alias("tried"), best)
    ok = F.col("b.score") > 0
    return out.select("doc_id", "para", "tried", F.when(ok, F.col("b.candidate")).alias("chosen"), (ok & ~F.col("b.verified")).alias("unverified"))


def guard_line(added: Column, removed: Column, semantic: Column, most: int = 8) -> Column:
    """A guard's result in one line, each list cut to its first ``most`` items; empty if nothing changed."""
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.concat_ws(", ", F.slice(c, 1, most)), F.when(F.size(c) > most, F.concat(F.lit(" and "), F.size(c) - most, F.lit(" more"))).otherwise("")))
    return F.concat_ws("; ", part("added", added), part("removed", removed), part("meaning", semantic))


def two_layers(docs: DataFrame) -> DataFrame:
    """Findings of each document before and after the code and the safe edits, and how many edits each layer made."""
    from . import autofix

    done = autofix.fixed(docs)
    count = lambda d, name: D.diagnose(d.select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias(name))
    out = done.select("doc_id", "code_edits", "safe_edits").join(count(docs, "before"), "doc_id", "left").join(count(done, "after"), "doc_id", "left")
    return out.fillna(0, ["before", "after"])


# --- reports and requests ------------------------------------------------------------------------------------------------------


def bilingual_findings(docs: DataFrame) -> DataFrame:
    """Findings of both engines as the desk lists them: the 31 checks over the text, English rules over a view in which Han is blank."""
    zh = D.policy(docs).select("doc_id", F.col("check").alias("rule"), F.substring("check", 1, 1).alias("category"), "severity", "handling", "start", "end", "matched")
    view = docs.select("doc_id", X.mask(F.col("text")).alias("text"))
    en = D.diagnose(view).where("lang = 'en'").join(docs.select("doc_id", F.col("text").alias("__source")), "doc_id")
    matched = F.substring("__source", F.col("start") + 1, F.col("end") - F.col("start"))
    en = en.select("doc_id", F.concat(F.lit("EN-"), "rule").alias("rule"), V.desk_category(F.col("rule")).alias("category"), "severity", V.desk_handling(F.col("handling")).alias("handling"), "start", "end", matched.alias("matched"))
    return V.merge_findings(zh, en)


def bilingual_report(docs: DataFrame) -> DataFrame:
    """Each document's checks, findings by handling, distinct affected paragraphs and status."""
    found = P.in_paragraph(bilingual_findings(docs), P.paragraph_segments(docs))
    kinds = [F.count_if(F.col("handling") == h).alias(f"n_{h}") for h in ("safe", "rewrite", "review")]
    high, medium = F.count_if(F.col("severity") == "high"), F.count_if(F.col("severity") == "medium")
    per = found.groupBy("doc_id").agg(*kinds, F.count("*").alias("n_findings"), F.count_distinct("para").alias("n_affected"), ((high >= 2) | (high + medium >= 6)).alias("bad"))
    out = docs.select("doc_id", V.checks_of(F.col("text")).alias("checks")).join(per, "doc_id", "left").fillna(0)
    status = F.when(F.col("bad"), "needs_work").when(F.col("n_findings") > 0, "review").otherwise("clear")
    return out.withColumn("status", status).drop("bad")


def prompt_items(found: DataFrame, most: int = 24) -> DataFrame:
    """What a request names of each document: each (rule, words) once, by place, the first ``most``."""
    once = found.groupBy("doc_id", "rule", "matched").agg(F.min("start").alias("start"))
    w = Window.partitionBy("doc_id").orderBy("start", "rule", "matched")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("doc_id", "place", "rule", "matched")


def overlaid_weights(weights: DataFrame, overlay: DataFrame) -> DataFrame:
    """``rule, weight`` with the overlay's weights in place of its rules'; rules of the overlay alone are left out."""
    own = overlay.select("rule", F.col("weight").alias("__new"))
    return weights.join(own, "rule", "left").select("rule", F.coalesce("__new", "weight").alias("weight"))


class Client(Protocol):
    """What a model client offers: ``n`` outputs for a request."""

    def complete(self, system: str, user: str, n: int = 1) -> list[str]: ...


class Echo:
    """A client without a model: it answers with the text between the marks of the request, through a function."""

    def __init__(self, change: Callable[[str], str] = str):
        self.change = change

    def complete(self, system: str, user: str, n: int = 1) -> list[str]:
        return [self.change(user.split("<<<TEXT>>>")[-1].split("<<<END>>>")[0].strip())] * n


def completions(requests: DataFrame, make: Callable[[], Client], n: int = 1, retries: int = 2) -> DataFrame:
    """``id, outputs, error`` of requests ``id, system, user``: a client for each task; what fails after retries has an error.

    A client that refuses ``n`` outputs at once is asked for one, n times.
    """

    def ask(client: Client, system: str, user: str) -> list[str]:
        try:
            got = client.complete(system, user, n)
        except TypeError:
            got = []
        return got if len(got) >= n else [client.complete(system, user, 1)[0] for _ in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for batch in batches:
            rows = []
            for key, system, user in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for left in range(retries, -1, -1):
                    try:
                        rows.append((key, ask(client, system or "", user or ""), None))
                        break
                    except Exception as e:  # whatever a remote service may raise; it ends up in the row
                        if not left:
                            rows.append((key, None, str(e) or type(e).__name__))
            k, o, e = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, batch.column(0).type), pa.array(o, pa.list_(pa.string())), pa.array(e, pa.string())], names=["id", "outputs", "error"])

    kind = requests.schema["id"].dataType.simpleString()
    return requests.select("id", "system", "user").mapInArrow(run, f"id {kind}, outputs array<string>, error string")
