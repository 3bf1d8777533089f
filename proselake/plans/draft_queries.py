"""Queries of drafts: packing, rebuilding, cleaning, scoring, reports, units; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import rules as T
from ..operators import drafts as A
from ..operators import edits as E
from ..operators import prose as P
from ..sources.tables import table
from .prose_queries import PARAS, _docs, _found, _found_sql
from .prose_queries import SQL as PROSE
from .review_queries import TEXTS, values, with_documents, with_documents_sql
from .rule_queries import EN, POLICY, POLICY_EXPECTED, LATER


def packed_paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(A.packed(F.col("text"), 700)).alias("pack", "text"))


def rebuilt_texts(spark, d):
    paras = P.paragraph_segments(_docs(spark, d)).where("para % 3 = 1").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("para", F.concat(F.lit("<"), "text", F.lit(">"))))).alias("edits"))
    return _docs(spark, d).join(paras, "doc_id", "left").select("doc_id", A.rebuilt(F.col("text"), F.col("edits")).alias("text"))


def source_breaks(spark, d):
    wide = F.regexp_replace("text", "\n", "\n\n")
    out = F.when(F.col("doc_id") % 3 == 0, F.concat(wide, F.lit("\nmore"))).otherwise(wide)
    return _docs(spark, d).select("doc_id", F.md5(A.with_source_breaks(F.col("text"), out)).alias("text"))


def tidied_en(spark, d):
    loose = F.regexp_replace(F.lower("text"), r"([a-z])n ([a-z])", "$1n ,, $2")
    return _docs(spark, d).select("doc_id", F.md5(A.tidy_en(loose)).alias("text"))


RAW = [
    "Here is the rewritten version:\nThe text.\nLet me know if it fits.", "```text\nThe text.\n```", "<output>The text.</output>", "“The text.”", "好的，以下是改写后的内容：\n正文在此。\n（以上为改写。）",
    "Plain text\nof two lines", "Here is one line only", "", "  \n", "<RESULT>\nA\nB\n</RESULT>", "# Title\n**Bold** text\n\n\n\nend", "「全文」", "Note: this\n\nBody here.\n\nNote: that",
]


def cleaned_outputs(spark, d):
    t = with_documents(spark, d, RAW, "id", "raw")
    return t.select("id", A.cleaned_output(F.col("raw")).alias("text"))


def plain_bases(spark, d):
    t = with_documents(spark, d, RAW, "id", "raw")
    return t.select("id", A.plain_base(F.col("raw")).alias("text"))


def typical_widths(spark, d):
    return _docs(spark, d).select("doc_id", A.typical_width(F.split("text", "\n")).alias("width"))


def _weights(which):
    return F.map_from_arrays(F.array_distinct(F.regexp_extract_all(which, F.lit("[A-Z][a-z]"), F.lit(0))), F.transform(F.array_distinct(F.regexp_extract_all(which, F.lit("[A-Z][a-z]"), F.lit(0))), lambda x: F.length(x) * F.lit(0.5)))


def legacy_scores(spark, d):
    p = P.turn_pairs(table(spark, d, "conversations"))
    return p.select("conv_id", "turn", A.legacy_score(F.col("src"), F.col("out"), _weights("src"), _weights("out"), ["Th", "An"]).alias("score"))


def whole_variants(spark, d):
    p = P.turn_pairs(table(spark, d, "conversations"))
    return p.select("conv_id", "turn", A.whole_variant(F.col("src"), F.col("out")).alias("text"))


def prompt_items(spark, d):
    return A.prompt_items(_found(spark, d), 8)


def overlaid_weights(spark, d):
    own = spark.createDataFrame([(r.rule, r.weight) for r in T.ZH], "rule string, weight double")
    return A.overlaid_weights(own, spark.createDataFrame([("S03", 9.0), ("L09", 0.25), ("none", 1.0)], "rule string, weight double"))


BOTH = [*EN, *POLICY[:24], TEXTS[4]]


def bilingual_findings(spark, d):
    t = spark.createDataFrame(list(enumerate(BOTH)), "doc_id long, text string")
    found = A.bilingual_findings(t).where("rule NOT LIKE 'EN-V-%' AND rule NOT LIKE 'EN-F%'")
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("hits"))


def bilingual_report(spark, d):
    t = spark.createDataFrame(list(enumerate(POLICY)), "doc_id long, text string")
    return A.bilingual_report(t).select("doc_id", "checks", "n_findings", "status")


def billable_units(spark, d):
    return _docs(spark, d).select("doc_id", E.billable_units_udf("text").alias("u")).select("doc_id", "u.*")


def guard_facts(spark, d):
    pairs = P.turn_pairs(table(spark, d, "conversations"))
    return pairs.select("conv_id", "turn", E.compare_udf("src", "out").alias("g")).select("conv_id", "turn", "g.added", "g.removed")


def clause_profiles(spark, d):
    return A.clause_profiles(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))


def best_candidates(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 2).cast("int").alias("para"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_partkey") % 100).cast("long").alias("candidate"), (F.col("l_quantity").cast("long") % 7 - 2).alias("score"), (F.col("l_returnflag") == "R").alias("verified"))
    return A.best_candidates(li)


def guard_lines(spark, d):
    p = P.fact_changes(P.turn_pairs(table(spark, d, "conversations")), "[A-Z][a-z]+")
    return p.select("conv_id", "turn", A.guard_line(F.col("added"), F.col("removed"), F.array().cast("array<string>"), 2).alias("line"))


def material_assessment(spark, d):
    found = _found(spark, d).withColumn("handling", F.expr("CASE rule WHEN 'F02' THEN 'code' WHEN 'RPT' THEN 'llm' ELSE 'report' END"))
    return P.material_assessment(_docs(spark, d), found, ["F04"]).select("doc_id", "n_features", "n_code", "n_llm", "n_report", "features_per_1000")


def metrics_en_style(spark, d):
    return P.metrics_en(_docs(spark, d), rounded=False).select("doc_id", "passive_ratio", "hedge_density", "transition_density", "digit_density")


NOT = "[^\\p{L}\\p{N}_]"
PAIRS = "(SELECT * FROM (SELECT conv_id, turn, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS out FROM conversations) WHERE out IS NOT NULL)"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
PASSIVE = f"(?i)(?:^|{NOT})(?:is|are|was|were|be|been|being|gets?|got)\\s+(?:[A-Za-z0-9_]+ly\\s+)?[A-Za-z0-9_]+(?:ed|en|wn|ne|nt|lt|de|ught|ken|ven|own)(?:$|{NOT})"
HEDGES = " + ".join(f"(len(low) - len(replace(low, '{h}', ''))) // {len(h)}" for h in L.HEDGES_EN)
TURNS = " + ".join(f"len(regexp_extract_all(two, '(?:^|{NOT}){t.replace(' ', '  ')}(?:$|{NOT})'))" for t in L.TRANSITIONS_EN)
SENTENCES = """len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(trim(x, ' ' || chr(10) || chr(9) || chr(13))) > 0))"""
FACT = "list_transform(list_distinct(regexp_extract_all({0}, '{1}')), lambda x: '{2}:' || x)"
FACTS = {"number": E.NUMBER.pattern, "citation": E.CITATION.pattern, "name": E.NAME.pattern}
ALL = lambda c: "list_concat(list_concat(" + ", ".join(FACT.format(c, p, k) + (")" if k == "citation" else "") for k, p in FACTS.items()) + ")"
WORD = "[\\p{Latin}\\p{Nd}]"
META = " OR ".join([f"contains(x, '{w}')" for w in A.META_ZH] + ["contains(lower(x), '" + w.replace("'", "''") + "')" for w in A.META_EN])
ABOUT = f"(len(x) <= 80 AND len({STRIP.format('x')}) > 0 AND ({META}))"
BLANK = f"len({STRIP.format('x')}) = 0"


def _bilingual() -> str:
    from .rule_queries import EN_EXPECTED, _count, _hedges, _patterns

    checks = {c.check: c.pattern for c in T.POLICY if c.pattern and c.check not in LATER}
    en = [_count("EN-" + r, p) for r, p in _patterns(T.EN).items()] + [_hedges(L.HEDGES_EN, "lower(text)").replace("'S09'", "'EN-S09'")]
    zh = " UNION ALL ".join(_count(r, p) for r, p in checks.items())
    masked = "(SELECT doc_id, regexp_replace(text, '[\\x{4e00}-\\x{9fff}]', ' ', 'g') AS text FROM t0 WHERE regexp_matches(text, '[A-Za-z]'))"
    late = [(i + len(EN), c, n) for i, c, n in POLICY_EXPECTED if i < 24] + [(i, "EN-" + r, n) for i, r, n in EN_EXPECTED]
    return f"""WITH t0(doc_id, text) AS (VALUES {values(enumerate(BOTH))}), z AS (WITH t AS (SELECT * FROM t0) {zh}), e AS (WITH t AS {masked} {' UNION ALL '.join(en)})
        SELECT CAST(doc_id AS BIGINT) AS doc_id, rule, CAST(hits AS BIGINT) AS hits FROM (SELECT * FROM z UNION ALL SELECT * FROM e{' UNION ALL SELECT * FROM (VALUES ' + values(late) + ')' if late else ''}) WHERE hits > 0"""


def _report() -> str:
    from .rule_queries import SQL as own

    severe = "CASE rule " + " ".join(f"WHEN '{c.check}' THEN '{c.severity}'" for c in T.POLICY) + " END"
    return f"""WITH h AS ({own['policy_hits']}), s AS (SELECT doc_id, CAST(sum(hits) AS BIGINT) AS n, sum(hits) FILTER ({severe} = 'high') AS high, sum(hits) FILTER ({severe} = 'medium') AS medium FROM h GROUP BY 1)
        SELECT CAST(t.doc_id AS BIGINT) AS doc_id, 31 AS checks, coalesce(n, 0) AS n_findings, CASE WHEN coalesce(high, 0) >= 2 OR coalesce(high, 0) + coalesce(medium, 0) >= 6 THEN 'needs_work' WHEN n > 0 THEN 'review' ELSE 'clear' END AS status
        FROM (VALUES {values(enumerate(POLICY))}) AS t(doc_id, text) LEFT JOIN s ON s.doc_id = t.doc_id"""


SQL = {
    "packed_paragraphs": f"""WITH RECURSIVE p AS ({PARAS}), c AS (SELECT doc_id, para, text, 0 AS pack, len(text) AS size FROM p WHERE para = 0
            UNION ALL SELECT p.doc_id, p.para, p.text, CASE WHEN c.size + len(p.text) <= 700 THEN c.pack ELSE c.pack + 1 END, CASE WHEN c.size + len(p.text) <= 700 THEN c.size + 2 + len(p.text) ELSE len(p.text) END
            FROM c JOIN p ON p.doc_id = c.doc_id AND p.para = c.para + 1)
        SELECT doc_id, pack, string_agg(text, chr(10) || chr(10) ORDER BY para) AS text FROM c GROUP BY 1, 2
        UNION ALL SELECT doc_id, 0, text FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id)""",
    "rebuilt_texts": f"""WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
        n AS (SELECT *, {STRIP.format('line')} AS own, len({STRIP.format('line')}) > 0 AS full_, sum(CAST(len({STRIP.format('line')}) > 0 AS INT)) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para FROM l)
        SELECT doc_id, string_agg(CASE WHEN full_ AND para % 3 = 1 THEN regexp_extract(line, '^\\s*') || '<' || own || '>' || regexp_extract(line, '\\s*$') ELSE line END, chr(10) ORDER BY i) AS text FROM n GROUP BY doc_id""",
    "source_breaks": f"""WITH o AS (SELECT doc_id, text, replace(text, chr(10), chr(10) || chr(10)) || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'more' ELSE '' END AS out FROM documents)
        SELECT doc_id, md5(CASE WHEN doc_id % 3 > 0 AND NOT regexp_matches(text, '^\\s*\\n|\\n\\s*$|\\n\\s+\\n') THEN text ELSE out END) AS text FROM o""",
    "tidied_en": """WITH a AS (SELECT doc_id, regexp_replace(lower(text), '([a-z])n ([a-z])', '\\1n ,, \\2', 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '\\s+([.,;:!?])', '\\1', 'g') AS t FROM a),
        c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[.](?:\\s*[.])+', '.', 'g'), ',(?:\\s*,)+', ',', 'g'), ';(?:\\s*;)+', ';', 'g'), ':(?:\\s*:)+', ':', 'g'), '\\s+', ' ', 'g'), ' ') AS t FROM b),
        d AS (SELECT doc_id, regexp_extract(t, '^(?:(?:[-*•]|[0-9]+[.)])\\s)?') AS b, t FROM c), e AS (SELECT doc_id, b, string_split(regexp_replace(substr(t, len(b) + 1), '([.!?]\\s)([a-z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM d)
        SELECT doc_id, md5(b || array_to_string(list_transform(l, lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '')) AS text FROM e""",
    "cleaned_outputs": f"""WITH t AS (SELECT * FROM {with_documents_sql(RAW, 'id', 'raw')}), a AS (SELECT id, {STRIP.format("regexp_replace(" + STRIP.format('raw') + ", '(?m)^[ \\t]*```[a-zA-Z0-9_-]*[ \\t]*$', '', 'g')")} AS t FROM t),
        b AS (SELECT id, {STRIP.format("CASE WHEN regexp_matches(t, '(?is)^<(" + A.TAGS + ")>.*</(" + A.TAGS + ")>$') THEN regexp_replace(t, '(?is)^<[a-z]+>|</[a-z]+>$', '', 'g') ELSE t END")} AS t FROM a),
        l AS (SELECT id, string_split(t, chr(10)) AS l FROM b), f AS (SELECT id, l, list_position(list_transform(l, lambda x: {ABOUT} OR {BLANK}), false) AS a,
            len(l) + 1 - list_position(list_transform(list_reverse(l), lambda x: {ABOUT} OR {BLANK} OR regexp_matches(x, '^\\s*[（(].{{0,80}}[）)]\\s*$')), false) AS z FROM l),
        k AS (SELECT id, {STRIP.format("array_to_string(CASE WHEN a IS NULL OR z IS NULL OR a = 0 OR z > len(l) OR z < a THEN l[len(l):len(l)] ELSE l[a:z] END, chr(10))")} AS t FROM f)
        SELECT CAST(id AS BIGINT) AS id, CASE WHEN len(t) > 2 AND regexp_matches(t, '(?s)^[「“"''].*[」”"'']$') THEN {STRIP.format('substr(t, 2, len(t) - 2)')} ELSE t END AS text FROM k""",
    "plain_bases": f"""WITH t AS (SELECT * FROM {with_documents_sql(RAW, 'id', 'raw')}), a AS (SELECT id, regexp_replace(trim(raw), '(?m)^```[a-zA-Z]*\\n?|```$', '', 'g') AS t FROM t),
        b AS (SELECT id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT starts_with(ltrim(x), '#')), chr(10)) AS t FROM a)
        SELECT CAST(id AS BIGINT) AS id, {STRIP.format("regexp_replace(regexp_replace(t, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM b""",
    "typical_widths": f"""SELECT doc_id, CAST(list_sort(s)[len(s) // 2 + 1] AS INT) AS width FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: len({STRIP.format('x')})), lambda n: n > 0) AS s FROM documents)""",
    "legacy_scores": f"""WITH x AS (SELECT *, list_distinct(regexp_extract_all(src, '[A-Z][a-z]')) AS a, list_distinct(regexp_extract_all(out, '[A-Z][a-z]')) AS b, len(out) / CAST(greatest(len(src), 1) AS DOUBLE) AS share FROM {PAIRS})
        SELECT conv_id, turn, CASE WHEN len(trim(out)) = 0 THEN -9000.0 WHEN NOT share BETWEEN CAST(0.70 AS DOUBLE) AND CAST(1.35 AS DOUBLE) THEN -8800.0
            ELSE CAST(len(a) - len(b) AS DOUBLE) - CAST(1.5 AS DOUBLE) * len(list_filter(b, lambda y: NOT list_contains(a, y) AND y NOT IN ('Th', 'An'))) - abs(share - 1) END AS score FROM x""",
    "whole_variants": f"SELECT conv_id, turn, CASE WHEN len(out) < len(src) * CAST(0.4 AS DOUBLE) THEN src ELSE out END AS text FROM {PAIRS}",
    "prompt_items": f"""WITH f AS ({_found_sql()}), o AS (SELECT doc_id, rule, matched, min(start) AS s FROM f GROUP BY 1, 2, 3)
        SELECT doc_id, CAST(n AS INT) AS place, rule, matched FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, rule, matched) AS n FROM o) WHERE n <= 8""",
    "overlaid_weights": f"SELECT rule, CAST(CASE rule WHEN 'S03' THEN 9 WHEN 'L09' THEN 0.25 ELSE weight END AS DOUBLE) AS weight FROM (VALUES {values((r.rule, r.weight) for r in T.ZH)}) AS t(rule, weight)",
    "bilingual_findings": _bilingual(),
    "bilingual_report": _report(),
    "billable_units": f"""WITH c AS (SELECT doc_id, regexp_replace(text, '[\\p{{Cf}}\\p{{Cc}}\\x{{FE00}}-\\x{{FE0F}}]', CASE WHEN 1 = 1 THEN '' END, 'g') AS t, regexp_replace(text, '[\\n\\r\\t]', ' ', 'g') AS s FROM documents),
        u AS (SELECT doc_id, regexp_replace(s, '[\\p{{Cf}}\\p{{Cc}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g') AS t FROM c),
        n AS (SELECT doc_id, len(regexp_extract_all(t, '{WORD}(?:[\\p{{Latin}}\\p{{Nd}}\\p{{M}}]|[''’]{WORD})*')) AS words, len(regexp_extract_all(t, '\\p{{Han}}')) AS han,
            len(regexp_extract_all(regexp_replace(t, '{WORD}(?:[\\p{{Latin}}\\p{{Nd}}\\p{{M}}]|[''’]{WORD})*', '', 'g'), '[^\\p{{Han}}\\p{{P}}\\p{{Z}}\\s]')) AS other FROM u)
        SELECT doc_id, words, han, other, words + han + other AS total FROM n""",
    "clause_profiles": f"""WITH s AS (SELECT conv_id * 1000 + turn AS doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '[.](\\s|$)', chr(10) || '\\1', 'g'), '[，；。！？\\n,;!?]'), lambda x: {STRIP.format('x')}), lambda x: len(x) > 0) AS l FROM conversations),
        c AS (SELECT doc_id, unnest(range(len(l))) AS clause, unnest(l) AS text FROM s)
        SELECT doc_id, CAST(clause AS INT) AS clause, text, regexp_extract_all(text, '{FACTS['number']}') AS numbers, regexp_extract_all(text, '{FACTS['citation']}') AS citations, regexp_extract_all(text, '{FACTS['name']}') AS names,
            lower(regexp_replace(regexp_replace(text, '{FACTS['citation']}', '@', 'g'), '{FACTS['number']}', '#', 'g')) AS skeleton FROM c""",
    "best_candidates": """WITH c AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 2 AS INT) AS para, l_linenumber * 1000000 + l_suppkey * 100 + l_partkey % 100 AS candidate, CAST(l_quantity AS BIGINT) % 7 - 2 AS score, l_returnflag = 'R' AS verified FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para ORDER BY score DESC, candidate) AS n, count(*) OVER (PARTITION BY doc_id, para) AS tried FROM c)
        SELECT doc_id, para, tried, CASE WHEN score > 0 THEN candidate END AS chosen, score > 0 AND NOT verified AS unverified FROM r WHERE n = 1""",
    "guard_lines": """WITH f AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(src, '[A-Z][a-z]+')) AS a, list_distinct(regexp_extract_all(out, '[A-Z][a-z]+')) AS b FROM (SELECT conv_id, turn, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS out FROM conversations) WHERE out IS NOT NULL),
        x AS (SELECT conv_id, turn, list_sort(list_filter(b, lambda y: NOT list_contains(a, y))) AS p, list_sort(list_filter(a, lambda y: NOT list_contains(b, y))) AS m FROM f)
        SELECT conv_id, turn, concat_ws('; ', CASE WHEN len(p) > 0 THEN 'added: ' || array_to_string(p[1:2], ', ') || CASE WHEN len(p) > 2 THEN ' and ' || (len(p) - 2) || ' more' ELSE '' END END,
            CASE WHEN len(m) > 0 THEN 'removed: ' || array_to_string(m[1:2], ', ') || CASE WHEN len(m) > 2 THEN ' and ' || (len(m) - 2) || ' more' ELSE '' END END) AS line FROM x""",
    "material_assessment": f"""WITH f AS ({_found_sql()}), c AS (SELECT doc_id, count(*) FILTER (rule <> 'F04') AS n_features, count(*) FILTER (rule = 'F02') AS n_code, count(*) FILTER (rule = 'RPT') AS n_llm, count(*) FILTER (rule IN ('NUM', 'F04')) AS n_report FROM f GROUP BY 1)
        SELECT m.doc_id, coalesce(n_features, 0) AS n_features, coalesce(n_code, 0) AS n_code, coalesce(n_llm, 0) AS n_llm, coalesce(n_report, 0) AS n_report,
            CASE WHEN n_unit = 0 THEN 0.0 ELSE CAST(coalesce(n_features, 0) * 1000 AS DOUBLE) / n_unit END AS features_per_1000 FROM ({PROSE['material_density']}) m LEFT JOIN c ON c.doc_id = m.doc_id""",
    "guard_facts": f"""WITH p AS (SELECT conv_id, turn, {ALL('src')} AS a, {ALL('out')} AS b FROM {PAIRS})
        SELECT conv_id, turn, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM p""",
    "metrics_en_style": f"""WITH d AS (SELECT doc_id, text, lower(text) AS low, regexp_replace(text, '({NOT})', '\\1\\1', 'g') AS twice, regexp_replace(lower(text), '({NOT})', '\\1\\1', 'g') AS two,
            greatest(len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*')), 1) AS n FROM documents)
        SELECT doc_id, len(regexp_extract_all(twice, '{PASSIVE}')) / CAST(greatest({SENTENCES}, 1) AS DOUBLE) AS passive_ratio, CAST({HEDGES} AS DOUBLE) / n AS hedge_density,
            CAST({TURNS} AS DOUBLE) / n AS transition_density, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%?')) * 100 / CAST(n AS DOUBLE) AS digit_density FROM d""",
}
QUERIES = {name: globals()[name] for name in SQL}
