"""Queries of clauses and sentences of two versions of a text, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clause_words as W
from ..functions import markers as M
from ..functions import numbers as N
from ..functions import transforms as G
from ..operators import clauses as C
from ..operators import edit_table as T
from ..operators import moves as V
from ..operators import prose as P
from ..operators import runs as R
from ..sources.tables import table


def clause_alignment(spark, d):
    pairs = P.turn_pairs(table(spark, d, "conversations"))
    return C.aligned(pairs, ["conv_id", "turn"], "src", "out").select("conv_id", "turn", "at", "to", F.round("score", 9).alias("score"))


def local_changes(spark, d):
    pairs = P.turn_pairs(table(spark, d, "conversations"))
    return C.local_changes(pairs, ["conv_id", "turn"], "src", "out").select("conv_id", "turn", "at", "to", F.concat_ws(", ", "reasons").alias("reasons"))


def clause_bindings(spark, d):
    rows = C.with_facts(C.clause_rows(table(spark, d, "documents"), ["doc_id"], "text"))
    lists = [F.concat_ws("|", c).alias(c) for c in ("numbers", "labels", "bindings", "directed", "bounds")]
    return rows.select("doc_id", "at", *lists, F.size("terms").alias("n_terms"), "skeleton")


def moved_sentences(spark, d):
    lines = F.reverse(F.split(F.lower(F.regexp_replace("text", r"\. ", "! ")), "\n"))
    loose = F.transform(lines, lambda x, i: F.when(i % 6 == 2, F.regexp_replace(F.regexp_replace(x, "(th|en)([a-z])([a-z])", "$1$3"), "ion", "o")).otherwise(x))
    later = F.array_join(loose, "\n")
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return V.moved_sentences(docs.select("doc_id", F.regexp_replace("text", r"\. ", "! ").alias("text"), later.alias("later")), ["doc_id"], "text", "later")


#: Rules of the edit queries: two overlap, three count as low.
EDITS = {"close": ("[%&]{1,2}[.]", "."), "gap": (" {2,}", " "), "mark": ("[#*$%&|<>]{3,}", ""), "pair": ("uthe|theou", "t"), "stop": ("[.]{2,}", "."), "word": ("outh", "oth")}
LOW = ["gap", "mark", "stop"]


def _edited(spark, d):
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    terms = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]*outh[a-z]*"), F.lit(0))), 1, 5)
    found = T.edits_of(docs.withColumn("terms", terms), EDITS, ["doc_id", "terms"])
    kept = F.coalesce(T.within_budget(F.col("edits"), F.col("text"), LOW), F.col("edits"))
    kept = found.withColumn("edits", kept).withColumn("edits", T.keeping_terms(F.col("edits"), F.col("text"), F.col("terms")))
    return kept.withColumn("edits", T.without_overlaps(F.col("edits"))).withColumn("result", T.applied(F.col("text"), F.col("edits")))


def edited_documents(spark, d):
    return _edited(spark, d).select("doc_id", F.size("edits").alias("n_edits"), F.md5("result").alias("result"))


def document_edits(spark, d):
    return _edited(spark, d).select("doc_id", F.explode("edits").alias("e")).select("doc_id", "e.start", "e.end", "e.rule", "e.new")


def followed_words(spark, d):
    """Words in capitals, found in the old text, at their places in the new one."""
    made = _edited(spark, d)
    found = made.select("doc_id", F.explode(T.found_edits(F.col("text"), "[A-Z][a-z]{3,}", "", "name")).alias("e")).select("doc_id", "e.start", "e.end")
    there = T.followed(found, made, ["doc_id"]).join(made.select("doc_id", "result"), "doc_id")
    return there.select("doc_id", "start", "new_start", F.substr("result", F.col("new_start") + 1, F.col("new_end") - F.col("new_start")).alias("word"))


def _mixed(spark, d):
    """Documents whose every third line gets a Chinese one behind it, every ninth of these with Latin in it."""
    line = lambda x, i: F.when(i % 9 == 2, F.concat(x, F.lit("\n本文研究 BERT 方法的结果。"))).when(i % 3 == 2, F.concat(x, F.lit("\n\n我们分析了研究结果，方法有效。"))).otherwise(x)
    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", text.alias("text"))


def text_runs(spark, d):
    found = _mixed(spark, d).select("doc_id", F.posexplode(R.runs(F.col("text"))).alias("run", "r"))
    return found.select("doc_id", "run", "r.lane", "r.start", F.length("r.text").alias("length"), F.md5("r.text").alias("text"))


def lane_edits(spark, d):
    done = R.edited_runs(F.col("text"), {"en": lambda x: F.translate(x, "aeion", "AEION"), "zh": lambda x: F.concat(F.lit("["), x, F.lit("]"))})
    return _mixed(spark, d).select("doc_id", F.md5(done).alias("text"))


def number_atoms(spark, d):
    """Numbers of all documents, and of lines that write some of their figures otherwise."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    told = F.concat_ws(" ", F.lit("in"), F.concat(F.lit("-"), F.col("doc_id"), F.lit(".50 mg,")), F.concat("doc_id", F.lit("e-2;")), F.concat(F.lit("p < 0."), F.col("doc_id"), F.lit(",")), F.concat(F.lit("1×10^"), F.col("doc_id") % 9, F.lit(" kg; 10⁻³,")), F.concat(F.lit("3-"), F.col("doc_id"), F.lit("th, 1,0")), F.lit("007 %"))
    text = F.concat_ws("\n", "text", told)
    found = docs.select("doc_id", F.posexplode(N.atoms(text)).alias("at", "x"))
    return found.select("doc_id", "at", "x.written", N.value(F.col("x")).alias("value"))


def flattened_documents(spark, d):
    text, n = G.flattened(F.col("text"), ends=".!?", pause=",", stop=".")
    return table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", n.alias("n"), F.md5(text).alias("text"))


NOT = "[^\\p{L}\\p{N}_]"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _plain(name: str) -> str:
    """A class's English pattern without what RE2 lacks: edges are matched around the whole."""
    p = M.EN[name].replace("\\b", "").replace("'", "''")
    for ahead in ("(?!\\s+(?:only|just|merely|simply|more\\s+than|less\\s+than))", "(?!\\s+(?:more|less)\\s+than)", "(?!\\s*[+\\-−]?\\d)"):
        p = p.replace(ahead, "")
    return p


_BUT = {"negation": "not\\s+(?:only|just|merely|simply|more\\s+than|less\\s+than)|no\\s+(?:more|less)\\s+than", "only": "(?:only|solely|exclusively)\\s*[+\\-−]?\\d"}
_TIED = {"together": M.TOGETHER.split("(?i:")[1][:-1].replace("\\b", ""), "causing": M.CAUSING.split("(?i:")[1][:-1].replace("\\b", "")}


def _counts() -> str:
    out = []
    for name in C.CLASSES:
        n = f"len(regexp_extract_all(twice, '(?i)(?:^|{NOT})(?:{_plain(name)})(?:$|{NOT})'))" if name in M.EN else "0"
        out.append(n + (f" - len(regexp_extract_all(twice, '(?i)(?:^|{NOT})(?:{_BUT[name]})'))" if name in _BUT else ""))
    return "[" + ", ".join(out + [f"len(regexp_extract_all(whole, '(?i)(?:^|{NOT})(?:{p})(?:$|{NOT})'))" for p in _TIED.values()]) + "]"


def _skeleton() -> str:
    x = f"regexp_replace(regexp_replace(lower(clause), '{W.CITATION.replace(chr(39), chr(39) * 2)}', '@', 'g'), '([^\\p{{L}}\\p{{N}}_@#])', '\\1\\1', 'g')"
    for p in [*[_plain(n) for n in C.CLASSES if n in M.EN], *_TIED.values()]:
        x = f"regexp_replace({x}, '(?i)(^|{NOT})(?:{p})($|{NOT})', '\\1\\2', 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\d+(?:(?:[.]+|,+)\\d+)*', '#', 'g'), '[^a-z#@\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"


def _number(i: str) -> str:
    unit = f"CASE WHEN regexp_matches(q[{i} + 1], '^[%‰℃℉]') THEN q[{i} + 1][1] WHEN regexp_matches(q[{i} + 1], '^\\p{{L}}') THEN q[{i} + 1] WHEN regexp_matches(q[{i} + 1], '^\\s+$') AND regexp_matches(q[{i} + 2], '^\\p{{L}}') THEN q[{i} + 2] ELSE '' END"
    sign = f"CASE WHEN regexp_matches(q[{i} - 1], '[-−]$') AND NOT (len(q[{i} - 1]) = 1 AND regexp_matches(q[{i} - 2], '^[\\p{{L}}\\d]')) THEN '-' ELSE '' END"
    return f"({sign} || q[{i}] || CASE WHEN len({unit}) <= 24 THEN {unit} ELSE '' END)"


def _label(i: str) -> str:
    spaced = f"regexp_matches(q[{i} - 1], '^\\s+$')"
    named = f"{spaced} AND lower(q[{i} - 2]) IN ({', '.join(map(repr, W.LABEL_BEFORE))})"
    grouped = f"lower(q[{i}]) = 'group' AND {spaced} AND lower(q[{i} - 2]) IN ({', '.join(map(repr, W.GROUP_BEFORE))})"
    return f"CASE WHEN regexp_matches(q[{i}], '{W.LABEL}') THEN CASE WHEN {named} THEN lower(q[{i} - 2]) || ' ' || lower(q[{i}]) ELSE lower(q[{i}]) END WHEN {grouped} THEN lower(q[{i} - 2]) || ' group' END"


_EN_BOUNDS = [(" ".join(p.split()), sign) for sign, phrases in M.BOUNDS.items() for p in phrases if p.isascii()]
_PHRASE = "|".join(p.replace(" ", "\\s+") for p, _ in sorted(_EN_BOUNDS, key=lambda x: len(x[0]), reverse=True))
_KIND = "CASE lower(regexp_replace(x, '\\s+', ' ', 'g')) " + " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in _EN_BOUNDS) + " END"
_ACT = "CASE WHEN regexp_matches(x, '^(?:affect|influence)') THEN 'affect' WHEN regexp_matches(x, '^cause') THEN 'cause' WHEN regexp_matches(x, '^(?:include|contain)') THEN 'include' ELSE regexp_replace(x, '(?:s|ed)$', '') END"
_TRIPLE = f"(?i)([A-Za-z][A-Za-z0-9_-]*)\\s+{W.ACTS_EN}\\s+([A-Za-z][A-Za-z0-9_-]*)"
_ACTS = f"list_transform(list_transform(regexp_extract_all(clause, '{_TRIPLE}', 2), lambda x: lower(x)), lambda x: {_ACT})"


def _profiled(source: str, key: str) -> str:
    """CTEs s, c, q, f: the profiles of the clauses of ``source`` (key, side, text)."""
    return f"""s AS (SELECT {key}, side, list_filter(list_transform(string_split_regex(regexp_replace(text, '[.](\\s|$)', chr(10) || '\\1', 'g'), '[，；。！？\\n,;!?]'), lambda x: {STRIP.format("x")}), lambda x: len(x) > 0) AS l FROM ({source})),
        c AS (SELECT {key}, side, len(l) AS n, unnest(range(len(l))) AS pos, unnest(l) AS clause FROM s),
        q AS (SELECT *, ['', ''] || regexp_extract_all(clause, '{W.PIECE}') || ['', ''] AS q, regexp_replace(regexp_replace(clause, '(?i)(^|{NOT})(?:{_PHRASE})\\s*[+\\-−]?\\d', '\\1 ', 'g'), '({NOT})', '\\1\\1', 'g') AS twice, regexp_replace(clause, '({NOT})', '\\1\\1', 'g') AS whole FROM c),
        i AS (SELECT *, list_filter(range(3, len(q) - 1), lambda i: regexp_matches(q[i], '^\\d')) AS ni, list_filter(range(3, len(q) - 1), lambda i: ({_label("i")}) IS NOT NULL) AS li FROM q),
        f AS (SELECT {key}, side, n, pos, clause, list_transform(ni, lambda i: {_number("i")}) AS numbers, list_sort(list_distinct(list_transform(li, lambda i: {_label("i")}))) AS labels,
            list_sort(list_transform(list_filter(list_transform(ni, lambda i: [i, list_max(list_filter(li, lambda x: x < i))]), lambda z: z[2] IS NOT NULL AND len(array_to_string(q[z[2] + 1:z[1] - 1], '')) <= {W.LABEL_REACH}), lambda z: {_label("z[2]")} || '=' || {_number("z[1]")})) AS bindings,
            list_sort(regexp_extract_all(clause, '{W.CITATION.replace(chr(39), chr(39) * 2)}')) AS citations,
            list_transform(list_zip(regexp_extract_all(clause, '{_TRIPLE}', 1), {_ACTS}, regexp_extract_all(clause, '{_TRIPLE}', 3)), lambda t: lower(t[1]) || '>' || t[2] || '>' || lower(t[3])) AS directed,
            {_counts()} AS classes, list_sort(list_concat(list_transform(regexp_extract_all(clause, '(?i)(?:^|{NOT})({_PHRASE})\\s*[+\\-−]?\\d', 1), lambda x: {_KIND}), list_transform(regexp_extract_all(clause, '{M.COMPARATOR}|{M.EQUATION}'), lambda x: regexp_replace(x, '\\s+', '', 'g')))) AS bounds,
            list_filter(list_transform(list_filter(q, lambda x: regexp_matches(x, '^(?:[A-Za-z][A-Za-z0-9_-]+|[\\x{{4e00}}-\\x{{9fff}}])$')), lambda x: lower(x)), lambda x: x NOT IN ({", ".join(map(repr, W.STOP))})) AS terms, {_skeleton()} AS skeleton FROM i),
        g AS (SELECT *, list_max(classes) > 0 OR len(numbers) + len(labels) + len(citations) + len(bounds) > 0 AS sensitive FROM f)"""


_PAIRS = "(SELECT conv_id, turn, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS out FROM conversations)"
_SIDES = f"SELECT conv_id, turn, 'a' AS side, src AS text FROM {_PAIRS} WHERE out IS NOT NULL UNION ALL SELECT conv_id, turn, 'b', out FROM {_PAIRS} WHERE out IS NOT NULL"
_BEST = f"""WITH {_profiled(_SIDES, "conv_id, turn")},
        m AS (SELECT conv_id, turn, len(l) AS m FROM s WHERE side = 'b'),
        a AS (SELECT g.*, CAST(round_even(pos * greatest(m - 1, 0) / CAST(greatest(n - 1, 1) AS DOUBLE), 0) AS INT) AS e FROM g JOIN m USING (conv_id, turn) WHERE side = 'a' AND sensitive),
        p AS (SELECT a.*, b AS b, b.pos AS "to", CASE WHEN greatest(len(a.skeleton), len(b.skeleton)) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein(a.skeleton, b.skeleton) / CAST(greatest(len(a.skeleton), len(b.skeleton)) AS DOUBLE) END
            + len(list_intersect(a.terms, b.terms)) / CAST(greatest(len(list_distinct(list_concat(a.terms, b.terms))), 1) AS DOUBLE)
            + CAST(CASE WHEN len(a.labels) = 0 THEN 0 WHEN a.labels = b.labels THEN 1.5 WHEN len(b.labels) > 0 THEN -1.5 ELSE -0.6 END AS DOUBLE) AS score
            FROM a LEFT JOIN g b ON b.side = 'b' AND b.conv_id = a.conv_id AND b.turn = a.turn AND abs(b.pos - a.e) <= {C.WINDOW}),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY score DESC, "to") AS k FROM p)"""
_REASONS = [
    f"CASE WHEN score < {C.ALIKE} THEN 'not aligned' END",
    *[f"CASE WHEN {c} <> b.{c} THEN '{c}' END" for c in ("numbers", "citations", "bindings")],
    "CASE WHEN directed <> b.directed THEN 'direction' END",
    "CASE WHEN len(labels) > 0 AND skeleton <> b.skeleton THEN 'label' END",
    "CASE WHEN bounds <> b.bounds THEN 'bounds' END",
    *[f"CASE WHEN classes[{i + 1}] <> b.classes[{i + 1}] THEN '{name}' END" for i, name in enumerate([*C.CLASSES, *_TIED])],
    "CASE WHEN len(terms) >= 2 AND terms <> b.terms AND list_sort(terms) = list_sort(b.terms) THEN 'order' END",
]

def _spans(pattern: str, name: str) -> str:
    """(doc_id, start, end, name) of every match, by the lengths of what stands between matches."""
    m, b = f"regexp_extract_all(text, '{pattern}')", f"string_split_regex(text, '{pattern}')"
    return f"""SELECT doc_id, '{name}' AS name, CAST(sum(len(b) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) - len(m) AS INT) AS a, CAST(sum(len(b) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS z
        FROM (SELECT doc_id, unnest({m}) AS m, unnest({b}[1:len({m})]) AS b, unnest(range(len({m}))) AS i FROM d)"""


_LOWS = ", ".join(map(repr, LOW))
_NEWS = "CASE name " + " ".join(f"WHEN '{k}' THEN '{new}'" for k, (_, new) in EDITS.items()) + " END"
_EDITED = f"""WITH RECURSIVE d AS (SELECT doc_id, text, list_distinct([]::VARCHAR[]) AS none FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        f AS ({" UNION ALL ".join(_spans(p, k) for k, (p, _) in EDITS.items())}),
        n AS (SELECT doc_id, name, count(*) AS n FROM f WHERE name IN ({_LOWS}) GROUP BY 1, 2),
        l AS (SELECT n.*, sum(n) OVER (PARTITION BY doc_id) AS total, sum(n) OVER (PARTITION BY doc_id ORDER BY n, name) AS upto, greatest(1, round_even(len(text) / 1000 * 3, 0)) AS budget FROM n JOIN d USING (doc_id)),
        x AS (SELECT doc_id, name FROM l WHERE total <= budget OR total - upto >= budget),
        t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]*outh[a-z]*')) AS t, generate_subscripts(regexp_extract_all(text, '[a-z]*outh[a-z]*'), 1) AS i FROM d),
        u AS (SELECT doc_id, t FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS k FROM t GROUP BY 1, 2) WHERE k <= 5),
        g AS (SELECT f.*, {_NEWS} AS new FROM f ANTI JOIN x ON x.doc_id = f.doc_id AND x.name = f.name),
        o AS (SELECT doc_id, name, string_agg(text[a + 1:z], chr(10) ORDER BY a) AS old, string_agg(new, chr(10) ORDER BY a) AS put FROM g JOIN d USING (doc_id) GROUP BY 1, 2),
        y AS (SELECT DISTINCT o.doc_id, o.name FROM o JOIN u USING (doc_id) JOIN d USING (doc_id) WHERE len(string_split(old, t)) >= len(string_split(text, t)) AND NOT contains(put, t)),
        h AS (SELECT g.*, row_number() OVER (PARTITION BY g.doc_id ORDER BY a, z DESC, g.name) AS k FROM g ANTI JOIN y ON y.doc_id = g.doc_id AND y.name = g.name),
        r AS (SELECT doc_id, k, z AS upto, true AS kept FROM h WHERE k = 1
            UNION ALL SELECT h.doc_id, h.k, CASE WHEN h.a >= r.upto THEN h.z ELSE r.upto END, h.a >= r.upto FROM r JOIN h ON h.doc_id = r.doc_id AND h.k = r.k + 1),
        e AS (SELECT h.doc_id, a, z, name, new, lag(z, 1, 0) OVER (PARTITION BY h.doc_id ORDER BY a) AS y FROM h JOIN r ON r.doc_id = h.doc_id AND r.k = h.k AND kept),
        p AS (SELECT e.doc_id, count(*) AS n, string_agg(text[y + 1:a] || new, '' ORDER BY a) || any_value(text)[max(z) + 1:] AS result FROM e JOIN d USING (doc_id) GROUP BY 1)"""

_RUNS = """WITH d AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 9 = 2 THEN x || chr(10) || '本文研究 BERT 方法的结果。' WHEN (i - 1) % 3 = 2 THEN x || chr(10) || chr(10) || '我们分析了研究结果，方法有效。' ELSE x END), chr(10)) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\n]+\\n*|\\n+')) AS t, generate_subscripts(regexp_extract_all(text, '[^\\n]+\\n*|\\n+'), 1) AS i FROM d),
        c AS (SELECT *, regexp_replace(t, '\\n+$', '') AS x FROM l),
        h AS (SELECT *, len(regexp_extract_all(x, '[\\x{4e00}-\\x{9fff}]')) AS h, len(regexp_extract_all(x, '[A-Za-z]')) AS e FROM c),
        p AS (SELECT *, CASE WHEN t[1] = chr(10) THEN 'raw' WHEN h > 0 AND regexp_matches(x, '[A-Za-z]+([ \\t]+[A-Za-z]+){2,}') THEN 'mixed' WHEN h + e = 0 OR (h >= 4 AND regexp_matches(x, '[，。！？；]|本文|研究|方法|结果|分析|探讨')) OR h / (h + e) > 0.3 THEN CASE WHEN e > 0 THEN 'protected' ELSE 'zh' END ELSE 'en' END AS lane FROM h),
        g AS (SELECT *, coalesce(CAST(lane <> lag(lane) OVER (PARTITION BY doc_id ORDER BY i) AS INT), 0) AS new FROM p),
        q AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run, sum(len(t)) OVER (PARTITION BY doc_id ORDER BY i) - len(t) AS start FROM g),
        r AS (SELECT doc_id, run, any_value(lane) AS lane, min(start) AS start, string_agg(t, '' ORDER BY i) AS text FROM q GROUP BY 1, 2)"""

_FLAT = f"regexp_replace(replace(translate(x[7] || x[8] || x[9], '{N.RAISED}', '{N.FLAT}'), '−', '-'), '^\\^?[+]?', '')"
_ATOMS = f"""WITH d AS (SELECT doc_id, concat_ws(chr(10), text, 'in -' || doc_id || '.50 mg, ' || doc_id || 'e-2; p < 0.' || doc_id || ', 1×10^' || doc_id % 9 || ' kg; 10⁻³, 3-' || doc_id || 'th, 1,0 007 %') AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        r AS (SELECT doc_id, list_zip({", ".join(f"list_transform(regexp_extract_all(text, '{N.ATOM}', {i}), lambda x: coalesce(x, ''))" for i in range(14))}) AS l FROM d),
        a AS (SELECT doc_id, unnest(list_filter(l, lambda x: x[13] = '')) AS x, generate_subscripts(list_filter(l, lambda x: x[13] = ''), 1) - 1 AS i FROM r),
        b AS (SELECT doc_id, i, x, CASE WHEN x[9] <> '' AND x[6] = '10' THEN '1' ELSE replace(x[6], ',', '') END AS bare, CASE WHEN x[7] || x[8] || x[9] = '' THEN 0 ELSE coalesce(TRY_CAST({_FLAT} AS INT), 0) END AS e FROM a),
        c AS (SELECT *, regexp_replace(replace(bare, '.', ''), '^0+([0-9])', '\\1') AS w, len(regexp_extract(bare, '[.]([0-9]*)$', 1)) AS places FROM b),
        z AS (SELECT *, CASE WHEN regexp_matches(w, '^0+$') THEN '0' ELSE regexp_replace(w, '0+$', '') END AS s FROM c)"""

_HEAD = "substr(s, 1, CAST(floor(len(s) / 2) AS BIGINT) + 10)"
SQL = {
    "flattened_documents": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        s AS (SELECT doc_id, i, unnest(p) AS s, generate_subscripts(p, 1) AS j FROM (SELECT doc_id, i, list_filter(string_split(regexp_replace(x, '([.!?])', '\\1' || chr(1), 'g'), chr(1)), lambda y: regexp_matches(y, '\\S')) AS p FROM l WHERE regexp_matches(x, '\\S'))),
        a AS (SELECT *, CASE WHEN contains({_HEAD}, ',') THEN len({_HEAD}) - strpos(reverse({_HEAD}), ',') ELSE -1 END AS at_ FROM s),
        c AS (SELECT doc_id, i, j, len(s) > 45 AND at_ > 12 AS cut, unnest(CASE WHEN len(s) > 45 AND at_ > 12 THEN [substr(s, 1, at_) || '.', substr(s, at_ + 2)] ELSE [s] END) AS s, unnest(CASE WHEN len(s) > 45 AND at_ > 12 THEN [1, 2] ELSE [1] END) AS h FROM a),
        g AS (SELECT *, len(s) < 18 AS short, sum(CAST(len(s) >= 18 AS INT)) OVER (PARTITION BY doc_id, i ORDER BY j, h) AS k FROM c),
        m AS (SELECT doc_id, i, k, short, CASE WHEN short THEN regexp_replace(string_agg(regexp_replace(s, '[.!?]+$', '') || ',', '' ORDER BY j, h), ',+$', '') || '.' ELSE any_value(s) END AS t, sum(CAST(short AS INT) + CAST(cut AND h = 2 AS INT)) AS n FROM g GROUP BY 1, 2, 3, 4),
        p AS (SELECT doc_id, i, string_agg(t, '' ORDER BY k, short) AS t, sum(n) AS n FROM m GROUP BY 1, 2)
        SELECT l.doc_id, CAST(coalesce(sum(p.n), 0) AS INT) AS n, md5(string_agg(coalesce(p.t, l.x), chr(10) ORDER BY l.i)) AS text FROM l LEFT JOIN p ON p.doc_id = l.doc_id AND p.i = l.i GROUP BY 1""",
    "number_atoms": f"""{_ATOMS} SELECT doc_id, CAST(i AS INT) AS "at", substr(x[1], len(x[2]) + 1) AS written,
            CASE WHEN x[9] <> '' AND x[6] <> '10' THEN 'power' WHEN x[3] <> '' THEN 'p' || x[4] WHEN x[10] <> '' THEN 'ordinal' ELSE 'number' END || ':' || CASE WHEN x[5] IN ('-', '−') AND s <> '0' THEN '-' ELSE '' END || s || 'e'
            || CASE WHEN s = '0' THEN 0 ELSE e - places + len(w) - len(s) END || ' ' || x[11] AS value FROM z""",
    "text_runs": f"""{_RUNS} SELECT doc_id, CAST(run AS INT) AS run, lane, CAST(start AS INT) AS start, CAST(len(text) AS INT) AS length, md5(text) AS text FROM r""",
    "lane_edits": f"""{_RUNS}, z AS (SELECT doc_id, run, CASE lane WHEN 'en' THEN translate(text, 'aeion', 'AEION') WHEN 'zh' THEN '[' || regexp_replace(text, '\\n+$', '') || ']' || regexp_extract(text, '\\n*$') ELSE text END AS t FROM r)
        SELECT d.doc_id, md5(coalesce(t, '')) AS text FROM d LEFT JOIN (SELECT doc_id, string_agg(t, '' ORDER BY run) AS t FROM z GROUP BY 1) y ON y.doc_id = d.doc_id""",
    "edited_documents": f"""{_EDITED} SELECT d.doc_id, CAST(coalesce(n, 0) AS INT) AS n_edits, md5(coalesce(result, text)) AS result FROM d LEFT JOIN p ON p.doc_id = d.doc_id""",
    "document_edits": f"""{_EDITED} SELECT doc_id, a AS start, z AS "end", name AS rule, new FROM e""",
    "followed_words": f"""{_EDITED}, w AS ({_spans("[A-Z][a-z]{3,}", "word")}),
        m AS (SELECT w.doc_id, w.a, w.z, coalesce(sum(len(e.new) - (e.z - e.a)) FILTER (e.z <= w.a), 0) AS shift, coalesce(bool_or(e.a < w.z AND w.a < e.z), false) AS touched FROM w LEFT JOIN e ON e.doc_id = w.doc_id GROUP BY 1, 2, 3)
        SELECT doc_id, a AS start, CAST(a + shift AS INT) AS new_start, text[a + 1:z] AS word FROM m JOIN d USING (doc_id) WHERE NOT touched""",
    "clause_alignment": f"""{_BEST} SELECT conv_id, turn, CAST(pos AS INT) AS "at", CAST("to" AS INT) AS "to", round(score, 9) AS score FROM r WHERE k = 1""",
    "local_changes": f"""{_BEST}, z AS (SELECT conv_id, turn, pos, "to", CASE WHEN "to" IS NULL THEN 'missing' ELSE concat_ws(', ', {", ".join(_REASONS)}) END AS reasons FROM r WHERE k = 1)
        SELECT conv_id, turn, CAST(pos AS INT) AS "at", CAST("to" AS INT) AS "to", reasons FROM z WHERE reasons <> ''""",
    "clause_bindings": f"""WITH {_profiled("SELECT doc_id, 0 AS side, text FROM documents", "doc_id")}
        SELECT doc_id, CAST(pos AS INT) AS "at", array_to_string(numbers, '|') AS numbers, array_to_string(labels, '|') AS labels, array_to_string(bindings, '|') AS bindings, array_to_string(directed, '|') AS directed, array_to_string(bounds, '|') AS bounds,
            CAST(len(terms) AS INT) AS n_terms, skeleton FROM g WHERE sensitive""",
    "moved_sentences": """WITH d AS (SELECT doc_id, regexp_replace(text, '[.] ', '! ', 'g') AS text, list_reverse(string_split(lower(regexp_replace(text, '[.] ', '! ', 'g')), chr(10))) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        v AS (SELECT doc_id, text, array_to_string(list_transform(l, lambda x, i: CASE WHEN i % 6 = 3 THEN regexp_replace(regexp_replace(x, '(th|en)([a-z])([a-z])', '\\1\\3', 'g'), 'ion', 'o', 'g') ELSE x END), chr(10)) AS later FROM d),
        t AS (SELECT doc_id, 0 AS side, string_split_regex(text, chr(10) || '+') AS p FROM v UNION ALL SELECT doc_id, 1, string_split_regex(later, chr(10) || '+') FROM v),
        p AS (SELECT doc_id, side, unnest(range(len(p))) AS para, unnest(p) AS text FROM t),
        u AS (SELECT DISTINCT doc_id, side, para, unit FROM (SELECT doc_id, side, para, unnest(list_transform(regexp_extract_all(text, '[^\\n。！？!?]+'), lambda x: regexp_replace(lower(x), '[^\\x{4e00}-\\x{9fff}a-z0-9]', '', 'g'))) AS unit FROM p) WHERE len(unit) >= 6),
        o AS (SELECT doc_id, unit, min(para) AS para FROM u WHERE side = 0 GROUP BY 1, 2 HAVING min(para) = max(para)),
        x AS (SELECT o.doc_id, o.para, o.unit, bool_or(u.para = o.para AND levenshtein(o.unit, u.unit) * 100 <= greatest(len(o.unit), len(u.unit)) * 28) AS kept,
            bool_or(u.para <> o.para AND (contains(o.unit, u.unit) OR contains(u.unit, o.unit) OR levenshtein(o.unit, u.unit) * 100 <= greatest(len(o.unit), len(u.unit)) * 18)) AS found
            FROM o JOIN u ON u.doc_id = o.doc_id AND u.side = 1 GROUP BY 1, 2, 3)
        SELECT doc_id, CAST(para AS INT) AS para, unit FROM x WHERE found AND NOT kept""",
}
QUERIES = {name: globals()[name] for name in SQL}
