"""Prose queries over the test tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import prose as P
from ..sources.tables import table

BOLD = r"\*\*[^*\n]{1,40}\*\*"
QUOTE = r"[\"']"
LIST = r"(?m)^[ \t]*(?:[-*•·]|[0-9]+[.)])[ \t]+"
RULES = {"NUM": (P.NUMBER, "low", 0.5), "F02": (BOLD, "medium", 1.5), "F04": (QUOTE, "low", 0.5), "RPT": (r"[!?]{2,}", "high", 2.5)}
#: A lexicon that the invented prose has words of.
TERMS = [("the", "T3"), ("ering", "T1"), ("tion", "T2"), ("that", "T3"), ("and", "T3"), ("que", "T2"), ("einge", "T1")]


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _found(spark, d):
    return P.rule_findings(_docs(spark, d), {rule: pattern for rule, (pattern, _, _) in RULES.items()})


def paragraph_segments(spark, d):
    return P.paragraph_segments(_docs(spark, d))


def sentence_segments(spark, d):
    return P.sentence_segments(_docs(spark, d))


def findings_numbers(spark, d):
    return P.findings(_docs(spark, d), "NUM", P.NUMBER)


def findings_bold(spark, d):
    return P.findings(_docs(spark, d), "F02", BOLD)


def findings_quotes(spark, d):
    return P.findings(_docs(spark, d), "F04", QUOTE)


def finding_in_paragraph(spark, d):
    return P.in_paragraph(_found(spark, d).drop("para"), P.paragraph_segments(_docs(spark, d)))


def protected_antijoin(spark, d):
    spans = P.findings(_docs(spark, d), "word", r"[A-Za-z]+[!*%&$#]+")
    return P.outside_spans(_found(spark, d).drop("para"), spans)


def longest_hit_wins(spark, d):
    found = P.findings(_docs(spark, d), "a", "the[a-z]*").unionByName(P.findings(_docs(spark, d), "b", "her|he")).unionByName(P.findings(_docs(spark, d), "c", "[a-z]+ion"))
    return P.longest_wins(found)


def paragraph_scores(spark, d):
    return P.paragraph_scores(_found(spark, d), P.paragraph_segments(_docs(spark, d)), {k: w for k, (_, _, w) in RULES.items()}, 4, 2)


def doc_summary(spark, d):
    return P.document_summary(_docs(spark, d), _found(spark, d), {k: s for k, (_, s, _) in RULES.items()})


def hard_limits(spark, d):
    return P.hard_limits(_docs(spark, d), _found(spark, d), {"F02": 5, "NUM": 3}, {"RPT": 0.2})


def metrics_en(spark, d):
    return P.metrics_en(_docs(spark, d), rounded=False).select("doc_id", "n_words", "n_sents", "sent_len_mean", "sent_len_cv", "ttr")


def metrics_en_all(spark, d):
    return P.metrics_en(_docs(spark, d))


def metric_flags(spark, d):
    m = P.metrics_en(_docs(spark, d), rounded=False)
    return P.metric_flags(m, [t for t in L.THRESHOLDS_EN if t[0] in ("ttr", "sent_len_cv")], uncalibrated=True)


def material_density(spark, d):
    return P.material_density(_docs(spark, d))


def ngram_repeat(spark, d):
    return P.ngram_repeat(_docs(spark, d))


def adjacent_head_repeat(spark, d):
    return P.adjacent_heads(_docs(spark, d))


def short_sentence_runs(spark, d):
    return P.short_runs(P.sentence_segments(_docs(spark, d)))


def same_opener_runs(spark, d):
    return P.same_openers(P.sentence_segments(_docs(spark, d)))


def lexicon_hits(spark, d):
    return P.lexicon_hits(_docs(spark, d), spark.createDataFrame(TERMS, "term string, tier string"))


def term_frequency(spark, d):
    return P.term_frequency(_docs(spark, d))


def lang_route(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", X.language(t).alias("lang"), F.regexp_count(t, F.lit("[A-Za-z]")).alias("latin"), F.regexp_count(t, F.lit(X.HAN)).alias("han"))


def lang_runs(spark, d):
    return P.language_runs(table(spark, d, "conversations"), "conv_id", "turn")


def mask_view(spark, d):
    return _docs(spark, d).select("doc_id", X.mask(F.col("text"), "[aeiou]").alias("masked"))


def normalize_report(spark, d):
    h = table(spark, d, "pages").select("page_id", F.col("html").alias("text"))
    return h.select("page_id", *[c.alias(k) for k, c in X.normal_report(F.col("text")).items()], F.length(X.normal_form(F.col("text"))).alias("n_chars"))


def fact_added_removed(spark, d):
    return P.fact_changes(P.turn_pairs(table(spark, d, "conversations")), "[A-Z][a-z]+")


def anchor_counts(spark, d):
    return P.anchor_counts(_docs(spark, d))


def label_number_asof(spark, d):
    return P.label_before_number(_docs(spark, d), "[a-z]{2,}")


def _found_sql() -> str:
    return " UNION ALL ".join(f"({_spans(k, p)})" for k, (p, _, _) in RULES.items())


def _spans(rule: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule}' AS rule, CAST(s AS INT) AS start, CAST(s + len(m) AS INT) AS "end", m AS matched FROM (
        SELECT doc_id, m[i] AS m, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS s
        FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM documents)))"""


PARAS = """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS para, CAST(s AS INT) AS start, CAST(s + len(t) AS INT) AS "end", t AS text FROM (
    SELECT doc_id, i, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS t,
        coalesce(list_sum(list_transform(ls[1:i-1], lambda x: len(x) + 1)), 0) + len(ls[i]) - len(regexp_replace(ls[i], '^\\s+', '')) AS s
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE len(t) > 0"""
SENTS = f"""SELECT doc_id, para, CAST(row_number() OVER (PARTITION BY doc_id, para ORDER BY i) - 1 AS INT) AS sent, s AS text FROM (
    SELECT doc_id, para, i, regexp_replace(c[i], '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, para, c, unnest(range(1, len(c) + 1)) AS i FROM (
    SELECT doc_id, para, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS c FROM ({PARAS})))) WHERE len(s) > 0"""
IN_PARA = 'SELECT f.*, para FROM f JOIN p ON f.doc_id = p.doc_id AND p.start <= f.start AND f."end" <= p."end"'
HEAD = f"WITH f AS ({_found_sql()}), p AS ({PARAS}), fp AS ({IN_PARA})"
WEIGHT = "CASE rule " + " ".join(f"WHEN '{k}' THEN {w}" for k, (_, _, w) in RULES.items()) + " END"
SEVERE = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (_, s, _) in RULES.items()) + " END"
WORDS = "regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*')"
WHOLE = """list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(trim(x, ' ' || chr(10) || chr(9) || chr(13))) > 0)"""
METRICS = f"""SELECT doc_id, greatest(len(w), 1) AS n_words, len(l) AS n_sents, coalesce(list_sum(l) / len(l), 0) AS sent_len_mean,
    CASE WHEN len(l) < 2 OR list_sum(l) = 0 THEN 0.0 ELSE sqrt(CAST(len(l) * list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l) AS DOUBLE)) / CAST(list_sum(l) AS DOUBLE) END AS sent_len_cv,
    len(list_distinct(list_transform(w, lambda x: lower(x)))) / greatest(len(w), 1) AS ttr FROM (
    SELECT doc_id, {WORDS} AS w, list_transform({WHOLE}, lambda s: len(regexp_extract_all(s, '[A-Za-z][A-Za-z''\\-]*'))) AS l FROM documents)"""

SQL = {
    "paragraph_segments": PARAS,
    "sentence_segments": SENTS,
    "findings_numbers": _spans("NUM", P.NUMBER),
    "findings_bold": _spans("F02", BOLD),
    "findings_quotes": _spans("F04", QUOTE),
    "finding_in_paragraph": f"{HEAD} SELECT * FROM fp",
    "protected_antijoin": f"""WITH f AS ({_found_sql()}), s AS ({_spans('word', '[A-Za-z]+[!*%&$#]+')})
        SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = f.doc_id AND f.start < s."end" AND f."end" > s.start)""",
    "longest_hit_wins": f"""WITH f AS (({_spans('a', 'the[a-z]*')}) UNION ALL ({_spans('b', 'her|he')}) UNION ALL ({_spans('c', '[a-z]+ion')})),
        r AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f)
        SELECT doc_id, rule, start, "end", matched FROM r WHERE reach IS NULL OR "end" > reach""",
    "paragraph_scores": f"""{HEAD}, s AS (SELECT doc_id, para, count(DISTINCT rule) AS raw_score, sum({WEIGHT}) AS weighted, count(*) AS n_findings FROM fp GROUP BY doc_id, para)
        SELECT p.doc_id, p.para, coalesce(raw_score, 0) AS raw_score, CAST(coalesce(weighted, 0) AS DOUBLE) AS weighted, coalesce(n_findings, 0) AS n_findings,
        CASE WHEN coalesce(raw_score, 0) >= 4 THEN 'high' WHEN coalesce(raw_score, 0) >= 2 THEN 'medium' ELSE 'low' END AS level FROM p LEFT JOIN s ON p.doc_id = s.doc_id AND p.para = s.para""",
    "doc_summary": f"""{HEAD}, c AS (SELECT doc_id, count(*) FILTER ({SEVERE} = 'high') AS h, count(*) FILTER ({SEVERE} = 'medium') AS m, count(*) FILTER ({SEVERE} = 'low') AS l FROM f GROUP BY doc_id),
        a AS (SELECT doc_id, count(DISTINCT para) AS n FROM fp GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS k FROM p GROUP BY doc_id)
        SELECT d.doc_id, len(regexp_replace(text, '\\s', '', 'g')) AS n_chars, coalesce(k, 0) AS n_paragraphs, coalesce(h, 0) AS n_high, coalesce(m, 0) AS n_medium, coalesce(l, 0) AS n_low,
        coalesce(a.n, 0) AS n_affected, CASE WHEN coalesce(h, 0) >= 2 OR coalesce(h, 0) + coalesce(m, 0) >= 6 THEN 'needs_work' WHEN coalesce(h, 0) + coalesce(m, 0) + coalesce(l, 0) > 0 THEN 'review' ELSE 'clear' END AS status
        FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN a ON d.doc_id = a.doc_id""",
    "hard_limits": f"""{HEAD}, n AS (SELECT doc_id, count(*) AS k FROM p GROUP BY doc_id)
        SELECT doc_id, rule, CAST(count(*) AS DOUBLE) AS value, CAST(CASE rule WHEN 'F02' THEN 5 ELSE 3 END AS DOUBLE) AS "limit" FROM f WHERE rule IN ('F02', 'NUM')
        GROUP BY doc_id, rule HAVING count(*) > CASE rule WHEN 'F02' THEN 5 ELSE 3 END
        UNION ALL SELECT fp.doc_id, rule, count(DISTINCT para) / max(k) AS value, CAST(0.2 AS DOUBLE) FROM fp JOIN n ON fp.doc_id = n.doc_id WHERE rule = 'RPT' GROUP BY fp.doc_id, rule
        HAVING count(DISTINCT para) / max(k) > CAST(0.2 AS DOUBLE)""",
    "metrics_en": METRICS,
    "metric_flags": f"""WITH m AS ({METRICS}) SELECT doc_id, 'ttr' AS metric, ttr AS value FROM m WHERE ttr < CAST(0.6 AS DOUBLE)
        UNION ALL SELECT doc_id, 'sent_len_cv', sent_len_cv FROM m WHERE sent_len_cv < CAST(0.15 AS DOUBLE)""",
    "material_density": f"""WITH u AS (SELECT doc_id, CAST(floor(len({WORDS}) * 16 / 10) AS INT) AS w, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '{P.NUMBER}')) AS n_digits FROM documents),
        x AS (SELECT doc_id, CASE WHEN latin = 0 THEN 0 ELSE w END AS n_unit, n_digits FROM u)
        SELECT doc_id, n_unit, n_digits, CASE WHEN n_unit = 0 THEN 0.0 ELSE CAST(n_digits * 1000 AS DOUBLE) / n_unit END AS density,
        CASE WHEN n_unit > 0 AND CAST(n_digits * 1000 AS DOUBLE) / n_unit >= CAST(17.92 AS DOUBLE) THEN 'good' WHEN n_unit > 0 AND CAST(n_digits * 1000 AS DOUBLE) / n_unit >= CAST(6.34 AS DOUBLE) THEN 'mid' ELSE 'low' END AS band,
        n_unit >= 300 AS reliable FROM x""",
    "ngram_repeat": """WITH g AS (SELECT doc_id, unnest(list_concat(list_concat(regexp_extract_all(text, '(?s).{4}'), regexp_extract_all(substr(text, 2), '(?s).{4}')),
            list_concat(regexp_extract_all(substr(text, 3), '(?s).{4}'), regexp_extract_all(substr(text, 4), '(?s).{4}')))) AS g FROM documents),
        n AS (SELECT doc_id, g, count(*) AS c FROM g GROUP BY doc_id, g), t AS (SELECT doc_id, CAST(coalesce(sum(c) FILTER (c > 1 AND regexp_matches(g, '\\S')), 0) AS BIGINT) AS repeated, CAST(sum(c) AS BIGINT) AS grams FROM n GROUP BY doc_id)
        SELECT d.doc_id, coalesce(repeated, 0) AS repeated, coalesce(grams, 0) AS grams, coalesce(repeated / grams, 0) AS ratio FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""",
    "adjacent_head_repeat": f"""WITH h AS (SELECT doc_id, CAST(lag(substr(text, 1, 2)) OVER (PARTITION BY doc_id ORDER BY para) = substr(text, 1, 2) AS INT) AS same FROM ({PARAS}))
        SELECT doc_id, coalesce(sum(same) / nullif(count(same), 0), 0) AS ratio FROM h GROUP BY doc_id""",
    "short_sentence_runs": f"""WITH s AS (SELECT *, len(regexp_replace(text, '\\s', '', 'g')) AS size FROM ({SENTS})),
        w AS (SELECT doc_id, para, sent, max(size) OVER x AS longest, count(*) OVER x AS n FROM s WINDOW x AS (PARTITION BY doc_id ORDER BY para, sent ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
        SELECT doc_id, para, sent FROM w WHERE n = 3 AND longest <= 8""",
    "same_opener_runs": f"""WITH s AS (SELECT doc_id, para, sent, substr(text, 1, 2) AS head FROM ({SENTS})),
        w AS (SELECT *, lead(head, 1) OVER x AS a, lead(head, 2) OVER x AS b FROM s WINDOW x AS (PARTITION BY doc_id ORDER BY para, sent)) SELECT doc_id, para, sent, head FROM w WHERE head = a AND head = b""",
    "lexicon_hits": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), l AS (SELECT * FROM (VALUES {', '.join(map(str, TERMS))}) AS v(term, tier))
        SELECT doc_id, term, tier, count(*) AS hits FROM t JOIN l USING (term) GROUP BY doc_id, term, tier""",
    "term_frequency": """SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*')) AS term FROM documents)
        GROUP BY doc_id, term HAVING (count(*) >= 2 AND regexp_matches(term, '^[A-Z]')) OR contains(term, '-')""",
    "lang_route": """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS han, text FROM documents)
        SELECT doc_id, CASE WHEN han + latin = 0 OR (han >= 4 AND regexp_matches(text, '[，。！？；]|本文|研究|方法|结果|分析|探讨')) OR han / (han + latin) > 0.3 THEN 'zh' ELSE 'en' END AS lang, CAST(latin AS INT) AS latin, CAST(han AS INT) AS han FROM c""",
    "lang_runs": """WITH l AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'zh' END AS lang FROM conversations),
        n AS (SELECT *, coalesce(CAST(lang <> lag(lang) OVER (PARTITION BY conv_id ORDER BY turn) AS INT), 1) AS new FROM l), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM n)
        SELECT conv_id, run, lang, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, run, lang""",
    "mask_view": "SELECT doc_id, regexp_replace(text, '[aeiou]', ' ', 'g') AS masked FROM documents",
    "fact_added_removed": """WITH t AS (SELECT conv_id, turn, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS out FROM conversations),
        f AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(src, '[A-Z][a-z]+')) AS a, list_distinct(regexp_extract_all(out, '[A-Z][a-z]+')) AS b FROM t WHERE out IS NOT NULL)
        SELECT conv_id, turn, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed,
        len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))) AS jaccard FROM f""",
    "anchor_counts": f"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '{P.NUMBER}'))) AS INT) AS numbers, CAST(len(list_distinct(regexp_extract_all(text, '\\[[0-9]+\\]'))) AS INT) AS citations,
        CAST(len(list_distinct(regexp_extract_all(text, '[A-Z][A-Za-z0-9]*'))) AS INT) AS names FROM documents""",
    "label_number_asof": f"""WITH n AS ({_spans('n', P.NUMBER)}), l AS ({_spans('l', '[a-z]{2,}')}),
        j AS (SELECT n.doc_id, n.start, n.matched AS number, max_by(l.matched, l."end") AS label, max(l."end") AS e FROM n LEFT JOIN l ON l.doc_id = n.doc_id AND l."end" <= n.start GROUP BY ALL)
        SELECT doc_id, start, number, CASE WHEN start - e <= 24 THEN label END AS label FROM j""",
    "normalize_report": """SELECT page_id, CAST(len(regexp_extract_all(html, '\\r\\n?')) AS INT) AS carriage_returns, CAST(len(regexp_extract_all(html, '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{00AD}\\x{180E}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]')) AS INT) AS invisible,
        CAST(len(regexp_extract_all(html, '[\\x{FE00}-\\x{FE0F}]')) AS INT) AS variation, CAST(len(regexp_extract_all(regexp_replace(html, '\\r\\n?', chr(10), 'g'), '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}]')) AS INT) AS control,
        CAST(len(regexp_extract_all(html, '[\\x{2000}-\\x{200A}\\x{202F}\\x{205F}]')) AS INT) AS odd_spaces,
        CAST(len(regexp_replace(regexp_replace(html, '\\r\\n?', chr(10), 'g'), '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{00AD}\\x{180E}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{FE00}-\\x{FE0F}\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}]', '', 'g')) AS INT) AS n_chars FROM pages""",
}

QUERIES = {name: globals()[name] for name in SQL} | {"metrics_en_all": metrics_en_all}
