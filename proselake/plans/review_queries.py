"""Queries of the reviewer's desk over the test tables and fixed texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import prose as P
from ..operators import review as V
from ..sources.tables import table
from .prose_queries import HEAD, PARAS, _docs, _found, _found_sql, _spans
from .prose_queries import SQL as PROSE

#: Texts of Chinese, English and mixed prose, since the tables hold no Chinese.
TEXTS = [
    "本研究分析了三种方法。结果表明，准确率为87%。",
    "為這個問題提供標準，說對於個們時來。",
    "這是简体。",
    "我们在 2020 年使用 BERT 模型。然而，结果不适用；因此需要分析。",
    "The method is a good one for this task 这个方法很好，适合研究。",
    "Plain English only. It works!",
    "",
    "12345 67890",
    "第一段：方法。\n第二段：结果！\n\n第三段：讨论？结论；完",
    "重复重复重复重复重复重复",
    "短句。短句。短句。这一句比其他句子都要长得多，因此平均值会变化。",
]


#: Ids of own rows are below it, those of documents behind it.
OWN_ROWS = 1000


def with_documents(spark, d, rows: list[str], key: str = "doc_id", column: str = "text"):
    """Own rows and the texts of all documents."""
    own = spark.createDataFrame(list(enumerate(rows)), f"{key} long, {column} string")
    return own.unionByName(table(spark, d, "documents").select((F.col("doc_id") + OWN_ROWS).alias(key), F.col("text").alias(column)))


def with_documents_sql(rows: list[str], key: str = "doc_id", column: str = "text") -> str:
    return f"(SELECT CAST({key} AS BIGINT) AS {key}, {column} FROM (VALUES {values(enumerate(rows))}) AS own({key}, {column}) UNION ALL SELECT doc_id + {OWN_ROWS}, text FROM documents)"


def texts(spark, d):
    return with_documents(spark, d, TEXTS)


def values(rows) -> str:
    """Rows as a VALUES list of SQL."""
    say = lambda x: "NULL" if x is None else str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(say, r))})" for r in rows)


def traditional(spark, d):
    return texts(spark, d).select("doc_id", V.is_traditional(F.col("text")).alias("traditional"))


def text_notices(spark, d):
    t = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("​"), F.col("html"), F.when(F.col("page_id") % 2 == 0, " \x01").otherwise("")).alias("text"))
    told = t.select("doc_id", F.explode(V.notices(X.normal_report(F.col("text")), V.is_traditional(F.col("text")))).alias("n")).select("doc_id", "n.*")
    return V.distinct_notices(told.unionByName(told))


def mask_han(spark, d):
    return texts(spark, d).select("doc_id", X.mask(F.col("text")).alias("masked"))


def report_checks(spark, d):
    return texts(spark, d).select("doc_id", V.checks_of(F.col("text")).alias("checks"))


def metrics_zh(spark, d):
    return P.metrics_zh(texts(spark, d), rounded=False)


def metrics_zh_whole(spark, d):
    return P.metrics_zh(_docs(spark, d), rounded=False).select("doc_id", "n_chars", "n_sents", "n_paras", "sent_len_mean")


def _rules(spark):
    return spark.createDataFrame([("en", "NUM", "llm"), ("en", "NUM", "report"), ("en", "F02", "code"), ("en", "RPT", "llm"), ("zh", "F04", "code"), ("en", "F04", "other")], "lang string, rule string, handling string")


def rule_handling(spark, d):
    return V.rule_handling(_found(spark, d).withColumn("lang", F.lit("en")), _rules(spark)).select("doc_id", "rule", "start", "handling")


def desk_findings(spark, d):
    found = V.rule_handling(_found(spark, d).withColumn("lang", F.lit("en")), _rules(spark))
    return V.desk_findings(found, _docs(spark, d))


def span_language(spark, d):
    return V.span_language(_found(spark, d).drop("para"), P.paragraph_segments(_docs(spark, d))).select("doc_id", "rule", "start", "lang")


def resolve_targets(spark, d):
    found = P.findings(_docs(spark, d), "NUM", P.NUMBER)
    asked = found.select("doc_id", "rule", (F.col("start") - F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("start"), "end", "matched")
    asked = asked.withColumn("rule", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("rule")))
    return V.resolve_targets(asked, found, _docs(spark, d), 2)


def table_filter(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_acctbal") > 0, "active").otherwise("closed").alias("status"))
    return V.table_filter(t, ["c_name", "c_mktsegment"], "1 Build", "active")


def _desk(spark, d):
    found = _found(spark, d).withColumn("severity", F.expr("CASE rule WHEN 'RPT' THEN 'high' WHEN 'F02' THEN 'medium' ELSE 'low' END"))
    return found.withColumns({"handling": F.expr("CASE WHEN rule IN ('NUM', 'RPT') THEN 'review' ELSE 'safe' END"), "category": F.substring("rule", 1, 1), "lang": F.expr("CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'zh' END")})


def desk_issues(spark, d):
    return V.issues(_desk(spark, d), "review")


def safe_cleanups(spark, d):
    return V.safe_cleanups(_desk(spark, d))


def rewrite_targets(spark, d):
    return V.rewrite_targets(_desk(spark, d).where("para IS NOT NULL"), ["NUM", "F04", "RPT"], "NUM", "F04").select("doc_id", "para", "rule", "start")


def start_gate(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"), "l_returnflag", "l_linestatus")
    gate = V.may_start(F.col("l_returnflag") != "R", F.col("q") % 3 > 0, F.col("q"), F.lit(45), F.col("l_partkey"), F.col("l_linestatus"), F.lit("O"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "q", gate.alias("may_start"))


def useful_ablations(spark, d):
    e = table(spark, d, "events")
    base = e.groupBy(F.col("user_id").alias("base"), F.col("event_type").alias("rule")).agg(F.count_if(F.col("event_id") % 4 == 0).alias("n"))
    variants = e.select("event_id", F.col("user_id").alias("base"), F.col("event_type").alias("rule"), (F.col("event_id") % 3).alias("new_text"), (F.col("event_id") % 2).alias("old_text"))
    return V.useful_ablations(base, variants).select("event_id")


def _lines(spark, d):
    lines = P.paragraph_segments(_docs(spark, d))
    spans = F.array(F.struct((F.col("doc_id") % 400).alias("start"), (F.col("doc_id") % 400 + 200).alias("end")))
    return lines.select("doc_id", F.col("para").alias("line"), "start", "end", spans.alias("targets"), F.array(F.struct(F.lit(300).alias("start"), F.lit(320).alias("end"))).alias("reviews"))


def eligible_lines(spark, d):
    return V.eligible_lines(_lines(spark, d)).select("doc_id", "line", "eligible")


def carried_lines(spark, d):
    lines = V.eligible_lines(_lines(spark, d)).select("doc_id", "line", (F.col("line") % 3 == 1).alias("blank"), "eligible")
    return V.carry_eligibility(lines).select("doc_id", "line", "carried")


def editable_parts(spark, d):
    lines = V.eligible_lines(_lines(spark, d)).select("doc_id", "line", F.col("eligible").alias("carried"), F.concat(F.lit("line "), "line").alias("text"))
    return V.editable_parts(lines)


def edit_windows(spark, d):
    found = P.findings(_docs(spark, d), "NUM", P.NUMBER).join(_docs(spark, d), "doc_id")
    return found.select("doc_id", F.col("start").alias("at"), V.edit_window(F.col("text"), F.col("start"), F.col("end")).alias("w")).select("doc_id", "at", "w.*")


def preflight(spark, d):
    return V.preflight(V.rewrite_targets(_desk(spark, d).where("para IS NOT NULL"), ["NUM", "F04", "RPT"], "NUM", "F04"))


def edited_findings(spark, d):
    edits = _docs(spark, d).where("doc_id % 4 > 0").select("doc_id", F.array(F.struct(F.lit(10).alias("start"), (F.col("doc_id") % 500).cast("int").alias("end"))).alias("spans"))
    return V.inside_edits(_found(spark, d).drop("para"), edits).select("doc_id", "rule", "start", "edited")


def changed_passages(spark, d):
    p = P.paragraph_segments(_docs(spark, d)).select("doc_id", "para", F.col("text").alias("before"), F.when(F.col("para") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("after"))
    return V.changed_passages(p, 6)


def noise_budget(spark, d):
    return V.exempt_by_budget(_found(spark, d).groupBy("doc_id", "rule").agg(F.count("*").alias("n")), 5)


def heaviest_paragraphs(spark, d):
    scored = _found(spark, d).where("para IS NOT NULL").groupBy("doc_id", "para").agg(F.count("*").alias("weighted"))
    return V.heaviest_paragraphs(scored, 3)


NAMES = r"[A-Z][a-z]+"


def first_names(spark, d):
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(NAMES), F.lit(0))))
    return _docs(spark, d).select("doc_id", V.first_items(names, 5).alias("f")).select("doc_id", "f.items", "f.more")


def _pairs(spark, d):
    p = P.turn_pairs(table(spark, d, "conversations"))
    return p.select("conv_id", "turn", *[F.array_distinct(F.regexp_extract_all(c, F.lit(NAMES), F.lit(0))).alias(c) for c in ("src", "out")], F.regexp_extract_all("src", F.lit("[a-z]+"), F.lit(0)).alias("bag"), F.regexp_extract_all("out", F.lit("[a-z]+"), F.lit(0)).alias("other"))


def lost_terms(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.array_sort(V.lost_terms(F.col("src"), F.col("out"), ["thesis", "andover", "inverse"])).alias("lost"))


def new_rules(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", V.new_rules(F.col("src"), F.col("out"), ["The", "And"]).alias("new"))


def same_bags(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", V.same_bag(F.col("bag"), F.reverse("bag")).alias("turned"), V.same_bag(F.col("bag"), F.col("other")).alias("same"))


def joined_facts(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", V.in_first_order(F.col("src"), F.col("out")).alias("facts"))


def missing_tables(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return e.select("user_id", V.missing_tables(F.col("have"), ["click", "view", "purchase", "refund"]).alias("missing"))


def shared_texts(spark, d):
    return V.shared_texts(_docs(spark, d).where("doc_id % 2 = 0"), _docs(spark, d).where("doc_id % 2 = 1")).select("doc_id")


def catalogue(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("product"))
    prices = table(spark, d, "lineitem").where("l_partkey % 3 > 0").groupBy(F.col("l_partkey").alias("product"), F.col("l_returnflag").alias("currency")).agg(F.max(F.col("l_quantity").cast("long")).alias("amount"))
    return V.catalogue(part, prices, "free").select("product", F.size("prices").alias("currencies"), F.element_at("prices", F.lit("A")).alias("price_a"))


def merged_findings(spark, d):
    a = P.findings(_docs(spark, d), "NUM", P.NUMBER)
    return V.merge_findings(a, a.unionByName(P.findings(_docs(spark, d), "F02", r"\*\*[^*\n]{1,40}\*\*")))


def merged_guards(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("lang"), F.array(F.col("event_type")).alias("added"), F.array((F.col("event_id") % 3).cast("string")).alias("removed"), (F.col("event_id") % 50 == 0).alias("blocked"), F.lit(2).alias("changes"))
    return V.merge_guards(e)


def edit_tally(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("rule"), F.upper("event_type").alias("name"), (F.col("user_id") % 2).cast("string").alias("lang"), (F.col("event_id") % 5).alias("n"), F.array((F.col("event_id") % 7).cast("string")).alias("reverted"))
    return V.edit_tally(e)


def rewrite_totals(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_returnflag") != "N").alias("targeted"), (F.col("l_linestatus") == "F").alias("accepted"), (F.col("l_quantity") > 25).alias("verified"), F.col("l_linenumber").cast("long").alias("safe"))
    return V.rewrite_totals(li)


def report_text(spark, d):
    return V.report_text(P.document_summary(_docs(spark, d), _found(spark, d), {"NUM": "low", "F02": "medium", "F04": "low", "RPT": "high"}))


T = f"{with_documents_sql(TEXTS)} AS t"
HAN = "[\\x{4e00}-\\x{9fff}]"
MARKS = "[" + "".join(dict.fromkeys(V.TRADITIONAL)) + "]"
ZH_SENTS = "list_filter(list_transform(regexp_extract_all({}, '[^。！？；\\n]*[。！？；\\n]|[^。！？；\\n]+$'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: len(x) > 0)"
ENRICHED = f"""WITH f AS ({_found_sql()}), p AS ({PARAS}), fp AS (SELECT f.*, p.para FROM f LEFT JOIN p ON f.doc_id = p.doc_id AND p.start <= f.start AND f."end" <= p."end"),
    h AS (SELECT *, CASE rule WHEN 'RPT' THEN 'high' WHEN 'F02' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN rule IN ('NUM', 'RPT') THEN 'review' ELSE 'safe' END AS handling,
        substr(rule, 1, 1) AS category, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang FROM fp)"""
HANDLED = "CASE rule WHEN 'NUM' THEN 'report' WHEN 'F02' THEN 'code' WHEN 'RPT' THEN 'llm' ELSE '' END"
PAIRS = f"""(SELECT conv_id, turn, list_distinct(regexp_extract_all(src, '{NAMES}')) AS src, list_distinct(regexp_extract_all(out, '{NAMES}')) AS out, src AS s, out AS o,
    regexp_extract_all(src, '[a-z]+') AS bag, regexp_extract_all(out, '[a-z]+') AS other FROM (SELECT conv_id, turn, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS out FROM conversations) WHERE out IS NOT NULL)"""
ZH_METRICS = """WITH p AS (SELECT doc_id, i, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {src}))),
    q AS (SELECT *, len(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]')) AS h, len(regexp_extract_all(t, '[A-Za-z]')) AS l FROM p WHERE len(t) > 0),
    z AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS zh FROM q WHERE h + l = 0 OR (h >= 4 AND regexp_matches(t, '[，。！？；]|本文|研究|方法|结果|分析|探讨')) OR h / (h + l) > 0.3 GROUP BY doc_id),
    u AS (SELECT d.doc_id, coalesce(zh, text) AS text FROM {src} d LEFT JOIN z ON z.doc_id = d.doc_id),
    v AS (SELECT doc_id, text, list_transform({sents}, lambda x: len(regexp_replace(x, '\\s', '', 'g'))) AS l,
        list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g')), lambda x: len(x) > 0), lambda x: len(x)) AS pl FROM u)"""
CV = "CASE WHEN len({0}) < 2 OR list_sum({0}) = 0 THEN 0.0 ELSE sqrt(CAST(len({0}) * list_sum(list_transform({0}, lambda x: x * x)) - list_sum({0}) * list_sum({0}) AS DOUBLE)) / CAST(list_sum({0}) AS DOUBLE) END"
SQL = {
    "traditional": f"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '{MARKS}'))) >= 3 AS traditional FROM {T}",
    "text_notices": """WITH t AS (SELECT page_id, len(regexp_extract_all(html, '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{00AD}\\x{180E}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]')) + 1 AS i,
            len(regexp_extract_all(regexp_replace(html, '\\r\\n?', chr(10), 'g'), '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}]')) + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS c,
            len(regexp_extract_all(html, '[\\x{FE00}-\\x{FE0F}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}]')) + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS o FROM pages)
        SELECT page_id AS doc_id, 'warn' AS level, 'invisible characters removed: ' || i AS text FROM t UNION ALL SELECT page_id, 'warn', 'control characters removed: ' || c FROM t WHERE c > 0
        UNION ALL SELECT page_id, 'info', 'odd blanks and variants made plain: ' || o FROM t WHERE o > 0""",
    "mask_han": f"SELECT doc_id, regexp_replace(text, '{HAN}', ' ', 'g') AS masked FROM {T}",
    "report_checks": f"""WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '{HAN}')) AS h, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM {T})
        SELECT doc_id, CASE WHEN h > 0 AND regexp_matches(text, '[A-Za-z]+([ \\t]+[A-Za-z]+){{2,}}') THEN 44 WHEN h + l = 0 OR (h >= 4 AND regexp_matches(text, '[，。！？；]|本文|研究|方法|结果|分析|探讨')) OR h / (h + l) > 0.3 THEN 31 ELSE 13 END AS checks FROM c""",
    "metrics_zh": ZH_METRICS.format(src=f"(SELECT * FROM {T})", sents=ZH_SENTS.format("text")) + f"""
        SELECT doc_id, CAST(len(regexp_replace(text, '\\s', '', 'g')) AS INT) AS n_chars, CAST(len(l) AS INT) AS n_sents, CAST(len(pl) AS INT) AS n_paras, coalesce(list_sum(l) / len(l), 0) AS sent_len_mean,
        CASE WHEN len(l) < 2 THEN 0.0 ELSE sqrt(CAST(len(l) * list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l) AS DOUBLE)) / len(l) END AS sent_len_sd, {CV.format('l')} AS sent_len_cv, {CV.format('pl')} AS para_len_cv,
        len(regexp_extract_all(text, '{P.NUMBER}')) * 100 / CAST(greatest(len(regexp_replace(text, '\\s', '', 'g')), 1) AS DOUBLE) AS digit_density,
        len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*')) * 100 / CAST(greatest(len(regexp_replace(text, '\\s', '', 'g')), 1) AS DOUBLE) AS latin_density FROM v""",
    "metrics_zh_whole": ZH_METRICS.format(src="documents", sents=ZH_SENTS.format("text")) + """
        SELECT doc_id, CAST(len(regexp_replace(text, '\\s', '', 'g')) AS INT) AS n_chars, CAST(len(l) AS INT) AS n_sents, CAST(len(pl) AS INT) AS n_paras, coalesce(list_sum(l) / len(l), 0) AS sent_len_mean FROM v""",
    "rule_handling": f"WITH f AS ({_found_sql()}) SELECT doc_id, rule, start, {HANDLED} AS handling FROM f",
    "desk_findings": f"""{HEAD}, l AS (SELECT f.*, p.para FROM f LEFT JOIN p ON f.doc_id = p.doc_id AND p.start <= f.start AND f."end" <= p."end")
        SELECT doc_id, 'EN-' || rule AS rule, CASE WHEN rule LIKE 'F%' THEN 'EN-F' ELSE 'EN-S' END AS category, CASE rule WHEN 'NUM' THEN 'review' WHEN 'F02' THEN 'safe' WHEN 'RPT' THEN 'rewrite' END AS handling, start, "end", matched, para + 1 AS para FROM l""",
    "span_language": f"""{HEAD}, l AS (SELECT f.*, p.text FROM f LEFT JOIN p ON f.doc_id = p.doc_id AND p.start <= f.start AND f."end" <= p."end")
        SELECT doc_id, rule, start, CASE WHEN regexp_matches(matched, '[A-Za-z]') OR regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'zh' END AS lang FROM l""",
    "resolve_targets": f"""WITH f AS ({_spans('NUM', P.NUMBER)}), a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE rule END AS rule, CAST(start - CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS start, "end", matched FROM f)
        SELECT doc_id, rule, start, "end", matched, CASE WHEN start < 0 THEN 'range' WHEN "end" - start > 2 THEN 'long' WHEN doc_id % 3 = 0 THEN 'stale' WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'ok' END AS state FROM a""",
    "table_filter": """SELECT c_custkey, c_name, c_mktsegment, 'active' AS status FROM customer WHERE c_acctbal > 0 AND contains(lower(c_name || ' ' || c_mktsegment), '1 build')""",
    "desk_issues": f"""{ENRICHED} SELECT doc_id, category, CAST(row_number() OVER (PARTITION BY doc_id, category ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, start, "end", rule) AS INT) AS place, rule, start
        FROM h WHERE handling = 'review'""",
    "safe_cleanups": f"{ENRICHED} SELECT doc_id, count(*) FILTER (handling = 'safe' AND lang <> 'en') AS n_safe FROM h GROUP BY doc_id",
    "rewrite_targets": f"""{ENRICHED}, w AS (SELECT *, max(CAST(lang = 'en' AND rule = 'NUM' AS INT)) OVER (PARTITION BY doc_id, para) AS led FROM h WHERE para IS NOT NULL)
        SELECT doc_id, para, rule, start FROM w WHERE rule IN ('NUM', 'F04', 'RPT') AND (led = 0 OR rule = 'F04')""",
    "start_gate": """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, l_returnflag <> 'R' AND CAST(l_quantity AS BIGINT) % 3 > 0 AND l_quantity > 0 AND l_quantity <= 45 AND l_partkey >= l_quantity AND l_linestatus = 'O' AS may_start FROM lineitem""",
    "useful_ablations": """SELECT event_id FROM events e WHERE event_id % 3 <> event_id % 2 AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type = e.event_type AND b.event_id % 4 = 0)""",
    "eligible_lines": f"""SELECT doc_id, para AS line, start < doc_id % 400 + 200 AND "end" > doc_id % 400 AND NOT (start < 320 AND "end" > 300) AS eligible FROM ({PARAS})""",
    "carried_lines": f"""WITH e AS (SELECT doc_id, para, start < doc_id % 400 + 200 AND "end" > doc_id % 400 AND NOT (start < 320 AND "end" > 300) AS ok FROM ({PARAS})),
        o AS (SELECT *, CASE WHEN para % 3 <> 1 THEN ok END AS own FROM e), c AS (SELECT *, lag(own IGNORE NULLS) OVER w AS before, lead(own IGNORE NULLS) OVER w AS after FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY para))
        SELECT doc_id, para AS line, CASE WHEN para % 3 <> 1 THEN ok ELSE coalesce(before AND after, false) END AS carried FROM c""",
    "editable_parts": f"""WITH e AS (SELECT doc_id, para AS line, start < doc_id % 400 + 200 AND "end" > doc_id % 400 AND NOT (start < 320 AND "end" > 300) AS carried FROM ({PARAS})),
        n AS (SELECT *, CAST(coalesce(carried <> lag(carried) OVER (PARTITION BY doc_id ORDER BY line), false) AS INT) AS new FROM e), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS part FROM n)
        SELECT doc_id, part, carried, min(line) AS first, max(line) AS last, string_agg('line ' || line, chr(10) ORDER BY line) AS text FROM r GROUP BY 1, 2, 3""",
    "edit_windows": f"""WITH f AS ({_spans('NUM', P.NUMBER)}), x AS (SELECT f.doc_id, f.start, f."end", matched, string_split(substr(text, 1, f.start), chr(10))[-1] AS lead, string_split(substr(text, f."end" + 1), chr(10))[1] AS tail FROM f JOIN documents d ON d.doc_id = f.doc_id)
        SELECT doc_id, start AS at, CAST(start - len(lead) AS INT) AS start, lead || matched || tail AS text FROM x""",
    "preflight": f"""{ENRICHED}, w AS (SELECT *, max(CAST(lang = 'en' AND rule = 'NUM' AS INT)) OVER (PARTITION BY doc_id, para) AS led FROM h WHERE para IS NOT NULL)
        SELECT doc_id, count(DISTINCT para) AS paragraphs, count(*) AS findings FROM w WHERE rule IN ('NUM', 'F04', 'RPT') AND (led = 0 OR rule = 'F04') GROUP BY doc_id""",
    "edited_findings": f"""WITH f AS ({_found_sql()}) SELECT doc_id, rule, start, doc_id % 4 > 0 AND 10 < "end" AND doc_id % 500 > start AS edited FROM f""",
    "changed_passages": f"""WITH c AS (SELECT doc_id, para, count(*) OVER (PARTITION BY doc_id) AS n FROM ({PARAS}) WHERE para % 2 = 0)
        SELECT doc_id, para, CAST(1 AS BIGINT) AS n FROM c WHERE n <= 6 UNION ALL SELECT DISTINCT doc_id, NULL, n FROM c WHERE n > 6""",
    "noise_budget": f"""WITH f AS ({_found_sql()}), c AS (SELECT doc_id, rule, count(*) AS n FROM f GROUP BY 1, 2)
        SELECT doc_id, rule, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY n, rule ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent, sum(n) OVER (PARTITION BY doc_id ORDER BY n, rule ROWS UNBOUNDED PRECEDING) <= 5 AS exempt FROM c""",
    "heaviest_paragraphs": f"""{HEAD}, c AS (SELECT doc_id, para, count(*) AS weighted FROM fp GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weighted DESC, para) AS n FROM c)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para) AS INT) AS place, para, weighted FROM r WHERE n <= 3""",
    "first_names": f"""WITH n AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '{NAMES}'))) AS n FROM documents) SELECT doc_id, n[1:5] AS items, CAST(greatest(0, len(n) - 5) AS INT) AS more FROM n""",
    "lost_terms": f"""SELECT conv_id, turn, list_sort(list_filter(src, lambda x: NOT list_contains(out, x) AND NOT contains('thesis|andover|inverse', lower(x)))) AS lost FROM {PAIRS}""",
    "new_rules": f"SELECT conv_id, turn, list_sort(list_filter(out, lambda x: NOT list_contains(src, x) AND x NOT IN ('The', 'And'))) AS new FROM {PAIRS}",
    "same_bags": f"SELECT conv_id, turn, true AS turned, list_sort(bag) = list_sort(other) AS same FROM {PAIRS}",
    "joined_facts": f"""SELECT conv_id, turn, (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i) GROUP BY x)) AS facts
        FROM (SELECT conv_id, turn, list_concat(regexp_extract_all(s, '{NAMES}'), regexp_extract_all(o, '{NAMES}')) AS l FROM {PAIRS}) WHERE len(l) > 0
        UNION ALL SELECT conv_id, turn, [] FROM {PAIRS} WHERE len(src) + len(out) = 0""",
    "missing_tables": """SELECT user_id, list_sort(list_filter(['click', 'view', 'purchase', 'refund'], lambda x: NOT list_contains(h, x))) AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS h FROM events GROUP BY 1)""",
    "shared_texts": "SELECT doc_id FROM documents d WHERE doc_id % 2 = 0 AND EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 1 AND o.text = d.text)",
    "catalogue": """SELECT 'free' AS product, 0 AS currencies, NULL AS price_a UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(count(DISTINCT l_returnflag) FILTER (l_partkey % 3 > 0) AS INT),
        CAST(max(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'A' AND l_partkey % 3 > 0) AS BIGINT) FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""",
    "merged_findings": f"""WITH f AS (({_spans('NUM', P.NUMBER)}) UNION ALL ({_spans('F02', '[*][*][^*' + chr(92) + 'n]{1,40}[*][*]')})) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", rule) AS INT) AS number FROM f""",
    "merged_guards": """SELECT user_id AS doc_id, list_sort(list(DISTINCT event_type)) AS added, list_sort(list(DISTINCT CAST(event_id % 3 AS VARCHAR))) AS removed, bool_or(event_id % 50 = 0) AS blocked, CAST(2 * count(*) AS BIGINT) AS changes FROM events GROUP BY 1""",
    "edit_tally": """SELECT event_type AS rule, upper(event_type) AS name, CAST(user_id % 2 AS VARCHAR) AS lang, CAST(sum(event_id % 5) AS BIGINT) AS n, list_sort(list(DISTINCT CAST(event_id % 7 AS VARCHAR))) AS reverted FROM events GROUP BY 1, 2, 3""",
    "rewrite_totals": """SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag <> 'N') AS n_targeted, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS n_accepted, count(*) FILTER (l_linestatus = 'F' AND l_quantity <= 25) AS n_unverified,
        count(*) FILTER (l_returnflag = 'N') AS untouched, CAST(sum(l_linenumber) AS BIGINT) AS safe_changes FROM lineitem GROUP BY 1""",
}

SQL["report_text"] = f"""SELECT doc_id, 'status: ' || status || chr(10) || 'characters: ' || n_chars || chr(10) || 'paragraphs: ' || n_affected || ' of ' || n_paragraphs || ' affected' || chr(10)
    || 'findings: ' || n_high || ' high, ' || n_medium || ' medium, ' || n_low || ' low' AS report FROM ({PROSE["doc_summary"]})"""
QUERIES = {name: globals()[name] for name in SQL}
