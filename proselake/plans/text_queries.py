"""Queries of operators that work text by text, and of experiments; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms as G
from ..operators import autofix as A
from ..operators import diagnose as D
from ..operators import edits as E
from ..operators import effects as X
from ..operators import prose as P
from ..operators import relational as R
from ..sources.pdf_lines import merged_lines as merged
from ..sources.tables import table
from .prose_queries import _spans
from .review_queries import TEXTS, texts, values, with_documents, with_documents_sql
from .rule_queries import EN, ZH


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def diagnose_findings(spark, d):
    return D.diagnose(_docs(spark, d))


def diagnose_scores(spark, d):
    return D.scores(D.diagnose(_docs(spark, d)), P.paragraph_segments(_docs(spark, d)))


def diagnose_violations(spark, d):
    found = D.diagnose(_docs(spark, d))
    return D.violations(found, D.scores(found, P.paragraph_segments(_docs(spark, d))))


def policy_findings(spark, d):
    return D.policy(_docs(spark, d))


def chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(E.chunks_udf("text")).alias("chunk", "c")).select("doc_id", "chunk", "c.text", "c.editable")


def diff_runs(spark, d):
    pairs = P.turn_pairs(table(spark, d, "conversations"))
    found = pairs.select("conv_id", "turn", F.posexplode_outer(E.diff_runs_udf("src", "out")).alias("run", "r"))  # outer: no filter that diffs again
    return found.where("run IS NOT NULL").select("conv_id", "turn", "run", "r.kind", "r.text")


def similarity_ratio(spark, d):
    return P.turn_pairs(table(spark, d, "conversations")).select("conv_id", "turn", E.similarity_udf("src", "out").alias("ratio"))


def guard_compare(spark, d):
    pairs = P.turn_pairs(table(spark, d, "conversations"))
    return pairs.select("conv_id", "turn", E.compare_udf("src", "out").alias("g")).select("conv_id", "turn", "g.*")


def _deltas(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("detector"), (F.col("user_id") % 7).cast("string").alias("rule"), (R.cents(F.col("value")) % 1200 - 300).cast("double").alias("delta"), F.lit(1.0).alias("purity"), F.lit(2).alias("n_changes"))


def effect_size(spark, d):
    return X.effect_sizes(_deltas(spark, d)).select("detector", "rule", "mean", "n", "verdict")


def effect_weights(spark, d):
    means = X.effect_sizes(_deltas(spark, d)).withColumn("mean", F.floor("mean").cast("long"))
    return X.effect_weights(means)


def purity(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 31).alias("variant"), F.col("event_type").alias("rule"), "event_id")
    before = e.where("event_id % 2 = 0").groupBy("variant", "rule").agg(F.count("*").alias("n"))
    after = e.where("event_id % 2 = 1").groupBy("variant", "rule").agg(F.count("*").alias("n"))
    return X.purity(before, after, e.groupBy("variant").agg(F.min("rule").alias("target")))


def product_lang(spark, d):
    return texts(spark, d).select("doc_id", A.product_language(F.col("text")).alias("lang"), A.lane(F.col("text")).alias("lane"))


def latin_islands(spark, d):
    return texts(spark, d).select("doc_id", A.islands(F.col("text")).alias("islands"))


LOOSE = ["好，。", "好，，的", "好。！？", "，开头", "结尾，", "a  b", "好，、。后", "一、二，三", "。、开\n；头，", "", "两行，\n。第二"]


def tidied_zh(spark, d):
    t = with_documents(spark, d, LOOSE, "id")
    return t.select("id", G.tidy(F.col("text")).alias("text"))


#: Transforms whose patterns look neither ahead nor behind.
PLAIN = [name for name, steps in G.REGISTRY.items() if not any(callable(s) or "(?<" in s[0] or "(?=" in s[0] or "(?!" in s[0] for s in steps)]
SAMPLES = [*ZH, *EN, "围绕三个问题展开分析。通过访谈完成了收集。", "However, it works. Overall, it boasts speed.", "一、方法\n二、结果\n三、讨论", "他说'好'，也说\"行\"。", "因此，可行。\n然而，不行。"]
SAMPLES += [
    "由此可见，全方位赋能，，闭环。", "众所周知，深入探讨，充分说明。", "总结：甲。说白了，乙。\n　简单说：结论：丙。", "当的时候时，当下雨的时候时,天黑时，走。", "开头。\n\n听起来不错。\n\n值得注意的是，丙。", "不难看出甲。",
    "保证了数据的安全性、隐私性和可靠性，高效、鲁棒、直观。北京、上海和粤港澳大湾区。", "# **一、 方法**\n第二 讨论。\n 三.结果 ", "不更是，更是更是。并非很好的办法而是坏的办法。", "结果上升，从而凸显了价值！",
    "未来工作将探索模型的可解释性，前景广阔。本研究具有重要的理论意义。这为后续研究提供了重要参考，不错吧你们说呢。", "似乎可能大概可可能能有效；或许似乎。", "有效。综上，可行。\n这一结果有力表明了甲。 ", "甲——乙---丙----丁--",
    "We delve into the realm. notably, it is robust .", "moreover,  we leverage a novel tapestry; fine", "It is not only fast but also cheap, but good but late.", "But it is, but but small but!", "Wow. experts argue that it works. data show that it is.",
    "The method plays a crucial role in vision , and it cuts the error by half. It opens new avenues.  The rest stays.", "It grew, ensuring speed; it fell, marking an end.", "A---b—c--d", "研究完成。然而，结果不适用。",
]


def ablations(spark, d):
    t = with_documents(spark, d, SAMPLES, "id")
    found = t.select("id", F.explode_outer(G.transforms(F.col("text"), list(G.REGISTRY))).alias("c"))  # outer: no filter that computes the array again
    return found.where("c IS NOT NULL").select("id", "c.rule", "c.text", "c.n")


def visible_chars(spark, d):
    E.register(spark)
    _docs(spark, d).createOrReplaceTempView("visible_chars_docs")
    return spark.sql("SELECT doc_id, visible_chars(text) AS n FROM visible_chars_docs")


def merged_lines(spark, d):
    pages = [["本文研究了一个重要的问题并且", "给出了方法。", "12", "1. 引言", "The method is de-", "scribed here"], [], ["Page 3 of 9", "only line"], ["- item one", "- item two"]]
    t = spark.createDataFrame(list(enumerate(pages)), "page long, lines array<string>")
    return t.select("page", merged(F.col("lines")).alias("paragraphs"))


def _scores(spark, d):
    e = table(spark, d, "events")
    variant = F.expr("CASE WHEN event_id % 9 = 0 THEN 'base' ELSE 'v' || event_id END")
    e = e.select(F.col("event_type").alias("detector"), (F.col("event_id") % 900).alias("base"), variant.alias("variant"), F.expr("CASE event_id % 4 WHEN 0 THEN 'ALL' ELSE 'R' || (event_id % 40) END").alias("rule"), R.cents(F.col("value")).cast("double").alias("score"), "event_id")
    return R.first_occurrence(e, ["detector", "base", "variant"], [F.col("event_id")])


def score_deltas(spark, d):
    return X.deltas(_scores(spark, d)).select("event_id", "detector", "base", "rule", "delta")


def sufficiency_gate(spark, d):
    return X.sufficiency(X.deltas(_scores(spark, d)))


def first_occurrences(spark, d):
    found = P.rule_findings(_docs(spark, d), {"a": "[0-9]+", "b": "[0-9]"}).select("doc_id", "rule", "start", "end", "matched")
    return R.first_occurrence(found, ["doc_id", "start"], [F.col("start"), F.col("end"), F.col("rule")])


def ordered_items(spark, d):
    p = P.turn_pairs(table(spark, d, "conversations"))
    p = p.withColumn("items", F.regexp_extract_all("src", F.lit("[A-Z][a-z]"), F.lit(0)))
    return p.select("conv_id", "turn", A.in_order("items", "out").alias("ordered"))


def grant_recalc_live(spark, d):
    o = table(spark, d, "orders")
    grants = o.select(F.col("o_orderkey").alias("grant_id"), F.lit(200).cast("long").alias("granted"), (F.col("o_orderkey") % 50).alias("refunded"), F.lit(7).cast("long").alias("remaining"), F.when(F.col("o_orderstatus") == "P", 1).alias("revoked_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("expires_at"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grant_id"), F.col("l_quantity").cast("long").alias("amount"), F.col("l_linestatus").alias("status"))
    return R.grant_recalc(grants, li, ["O"], 900)


_MARK = "chr(57344)"
#: Patterns that look around, without that: what stands before or behind is taken and put back.
_TAKEN = {
    "zh:L01": [(f"(?m)(^|[。！？；\\n]){G.SPACE}*{G._LEAD}{G.SPACE}*", "$1")],
    "zh:L09": [(f"(?m)(^|[。！？；\\n]){G.SPACE}*(?:说白了|说穿了|先说结论|直说吧)[，,]?{G.SPACE}*", "$1")],
    "zh:L11": [(f"([。！？；]){a}([，,])", f"$1{b}$2") for a, b in G.CONNECTIVES.items()],
    "zh:S05": [(p.replace("(?=[。！？])", "([。！？])"), "$1") for p, _ in G.ZH["S05"]],
    "zh:P02": [(p.replace(r"(?<![^。！？\n])", ""), new) for p, new in G.ZH["P02"]],
    "zh:F01": [("——|(-*)--", "$1，")],
    "en:S05": [(p.replace("(?=[.;!?])", "([.;!?])"), "$1") for p, _ in G.EN["S05"]],
    "en:F01": [("—|(-*)--", "$1, ")],
}


def _q(x: str) -> str:
    return x.replace("'", "''").replace("(?md)", "(?m)").replace("(?imd)", "(?im)")


def _sub(steps, table: str, counted: bool = True) -> str:
    """The table after replacements, one behind the other."""
    for pattern, new in steps:
        n = f"n + len(regexp_extract_all(text, '{_q(pattern)}'))" if counted else "n"
        table = f"SELECT r, id, regexp_replace(text, '{_q(pattern)}', '{_q(new.replace('$', chr(92)))}', 'g') AS text, {n} AS n FROM ({table})"
    return table


def _text(expr: str, table: str) -> str:
    return f"SELECT r, id, {expr} AS text, n FROM ({table})"


def _capitals_sql(table: str) -> str:
    cut = f"string_split(regexp_replace(text, '(^|[.!?]{G.SPACE}+)([a-z])', '\\1' || {_MARK} || '\\2', 'g'), {_MARK})"
    return _text(f"array_to_string(list_transform({cut}, lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(substr(x, 1, 1)) || substr(x, 2) END), '')", table)


def _words_sql(name: str) -> str:
    done = _sub(G.MENDED[name], _sub([(p, new) for _, p, new in G.WORDED[name]], "SELECT * FROM t"), counted=False)
    return _capitals_sql(done) if name.startswith("en:") else done


def _parts_sql(cut: str, hit: str, new: str, by: str) -> str:
    """Parts ``x`` of a text, of which those that fit are counted and replaced."""
    return f"SELECT r, id, array_to_string(list_transform(l, lambda x, i: CASE WHEN {hit} THEN {new} ELSE x END), {by}) AS text, len(list_filter(l, lambda x, i: {hit})) AS n FROM (SELECT r, id, {cut} AS l FROM t)"


def _put_sql(x: str, steps) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{_q(pattern)}', '{new}', 'g')"
    return x


def _lists_sql() -> str:
    items = f"list_filter(string_split(regexp_replace(x, '{G.LAST_ITEM}', '、\\1、\\2', 'g'), '、'), lambda y: y <> '')"
    sizes = f"list_transform({items}[2:], lambda y: len(y))"
    hit = f"contains(x, '、') AND len({items}) > {G.ITEMS} AND list_max({sizes}) - list_min({sizes}) <= {G.UNEVEN} AND len({items}[1]) >= list_min({sizes})"
    return _parts_sql(r"regexp_extract_all(text, '[^，。；：！？\n]+|[，。；：！？\n]+')", f"coalesce({hit}, false)", f"array_to_string({items}[1:{G.ITEMS}], '、')", "''")


def _headings_sql() -> str:
    own = f"regexp_replace(x, '^{G.SPACE}+|{G.SPACE}+$', '', 'g')"
    hit = f"regexp_matches(x, '{G.NUMBERED}') AND len({own}) <= {G.HEADING} AND NOT regexp_matches({own}, '[。！？]$')"
    return _parts_sql("string_split(text, chr(10))", hit, f"regexp_replace(x, '{G.NUMBERED}', '\\1')", "chr(10)")


def _endings_sql() -> str:
    left = _put_sql("x", [(f"[，,、]?{G.SPACE}*(?:{G.SET_ZH})", ""), (f"[，,、]{G.SPACE}*[^，。；！？]{{0,6}}([。！？]|\\n?\\z)", r"\1")])
    core = _put_sql(left, [(f"[，。；！？、]|{G.SPACE}", "")])
    return _parts_sql("regexp_extract_all(text, '[^。！？]*[。！？]|[^。！？]+')", f"regexp_matches(x, '{G.SET_ZH}')", f"CASE WHEN len({core}) >= {G.CORE_ZH} THEN {left} ELSE '' END", "''")


def _endings_en_sql() -> str:
    left = _put_sql("x", [(G.SET_EN, ""), (f"{G.SPACE}+([.,;:])", r"\1"), (rf",{G.SPACE}*\.", ".")])
    new = f"CASE WHEN len({_put_sql(left, [('[^A-Za-z]', '')])}) >= {G.CORE_EN} THEN {left} ELSE '' END"
    done = _parts_sql(f"string_split(regexp_replace(text, '([.!?]){G.SPACE}+', '\\1' || {_MARK}, 'g'), {_MARK})", f"regexp_matches(x, '{G.SET_EN}')", new, _MARK)
    return _text(f"array_to_string(list_filter(string_split(text, {_MARK}), lambda x: regexp_matches(x, '{G.SOLID}')), ' ')", done)


def _hedged_sql() -> str:
    l = "list_transform(regexp_extract_all(text, '[^。！？；]*[。！？；]|[^。！？；]+'), lambda x: {'x': x, 'kept': false, 'n': 0})"
    done = f"SELECT r, id, {l} AS l FROM t"
    for h in G.HEDGES:  # taken away as often as its first character occurs, since it may stand inside itself
        left = f"list_reduce(list_prepend(a.x, regexp_extract_all(a.x, '{h[0]}')), lambda y, z: replace(y, '{h}', ''))"
        gone = f"{{'x': {left}, 'kept': true, 'n': CAST(a.n + (len(a.x) - len({left})) // {len(h)} AS INT)}}"
        done = f"SELECT r, id, list_transform(l, lambda a: CASE WHEN NOT contains(a.x, '{h}') THEN a WHEN NOT a.kept THEN {{'x': a.x, 'kept': true, 'n': a.n}} ELSE {gone} END) AS l FROM ({done})"
    return f"SELECT r, id, array_to_string(list_transform(l, lambda a: a.x), '') AS text, list_sum(list_transform(l, lambda a: a.n)) AS n FROM ({done})"


def _openings_sql() -> str:
    at, (noted, new) = f"^(?:{G.OPENINGS})", G.NOTED
    hit = f"(i > 1 OR NOT contains(whole, chr(10) || chr(10))) AND regexp_matches(x, '{at}|^{noted}')"
    made = f"CASE WHEN regexp_matches(x, '{at}') THEN '这' || x ELSE regexp_replace(x, '^{noted}', '{new}') END"
    return _parts_sql("string_split(text, chr(10) || chr(10))", hit, made, "chr(10) || chr(10)").replace("AS l FROM t", "AS l, text AS whole FROM t")


def _but_sql() -> str:
    """Each ``but`` is marked with the white space around it; a word must come behind, which may be the next one."""
    found = f"(?i),?{G.SPACE}*\\bbut\\b{G.SPACE}+"
    cut = f"string_split(regexp_replace(text, '({found})', {_MARK} || '\\1', 'g'), {_MARK})"
    hits = f"list_filter(range(2, len(l) + 1), lambda i: regexp_matches(l[i] || coalesce(l[i + 1], ''), '^{found}[\\p{{L}}\\p{{N}}_]'))"
    both = _sub(G.EN["S03"][:2], "SELECT * FROM t")
    made = f"SELECT r, id, n, l, CASE WHEN n > 0 THEN h[1:1] ELSE h END AS h FROM (SELECT r, id, n, l, {hits} AS h FROM (SELECT r, id, n, {cut} AS l FROM ({both})))"
    return f"SELECT r, id, array_to_string(list_transform(l, lambda x, i: CASE WHEN list_contains(h, i) THEN ' and ' || regexp_replace(x, '^{found}', '') ELSE x END), '') AS text, n + len(h) AS n FROM ({made})"


def _even_sql() -> str:
    head, cut = "substr(s, 1, CAST(floor(len(s) / 2) AS BIGINT) + 10)", "len(s) > 45 AND at_ > 12"
    return f"""SELECT l.r, any_value(l.id) AS id, string_agg(coalesce(p.t, l.x), chr(10) ORDER BY l.i) AS text, coalesce(sum(p.n), 0) AS n FROM l LEFT JOIN (
        SELECT r, i, string_agg(t, '' ORDER BY k, short) AS t, sum(n) AS n FROM (SELECT r, i, k, short, CASE WHEN short THEN regexp_replace(string_agg(regexp_replace(s, '[。！？]+$', '') || '，', '' ORDER BY j, h), '，+$', '') || '。' ELSE any_value(s) END AS t, sum(CAST(short AS INT) + CAST(cut AND h = 2 AS INT)) AS n
        FROM (SELECT *, len(s) < 18 AS short, sum(CAST(len(s) >= 18 AS INT)) OVER (PARTITION BY r, i ORDER BY j, h) AS k
        FROM (SELECT r, i, j, {cut} AS cut, unnest(CASE WHEN {cut} THEN [substr(s, 1, at_) || '。', substr(s, at_ + 2)] ELSE [s] END) AS s, unnest(CASE WHEN {cut} THEN [1, 2] ELSE [1] END) AS h
        FROM (SELECT *, CASE WHEN contains({head}, '，') THEN len({head}) - strpos(reverse({head}), '，') ELSE -1 END AS at_
        FROM (SELECT r, i, unnest(p) AS s, generate_subscripts(p, 1) AS j FROM (SELECT r, i, list_filter(regexp_extract_all(x, '[^。！？]*[。！？]|[^。！？]+'), lambda y: regexp_matches(y, '{G.SOLID}')) AS p FROM l WHERE regexp_matches(x, '{G.SOLID}')))))) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2
        ) p ON p.r = l.r AND p.i = l.i GROUP BY 1"""


def _ablation_sql() -> str:
    """Each rule's steps in SQL, whose patterns cannot look around."""
    t, m = "SELECT * FROM t", _MARK
    own = {name: _words_sql(name) for name in G.WORDED} | {
        "zh:L05": _text(f"replace(text, {m}, '时')", _sub([("当([^，。；\\n]{2,20}?)时([，,])", "$1$2")], _text(f"replace(text, '的时候时', '的时候' || {m})", t))),
        "zh:S03": _sub(G.ZH["S03"][2:], _text(f"replace(text, {m}, '更')", _sub([("更是", "也")], _text(f"replace(text, '不更是', '不' || {m} || '是')", _sub(G.ZH["S03"][:1], t))))),
        "zh:L10": _openings_sql(), "zh:S01": _lists_sql(), "zh:S02": _headings_sql(), "zh:S08": _endings_sql(), "zh:S09": _hedged_sql(), "zh:BURST": _even_sql(),
        "en:S03": _but_sql(), "en:S07": _capitals_sql(_sub(G.EN["S07"][:-1], t)), "en:S08": _endings_en_sql(),
    }
    parts = [f"SELECT id, '{name}' AS rule, text, CAST(n AS INT) AS n FROM ({own.get(name) or _sub(_TAKEN.get(name, G.REGISTRY[name]), t)}) WHERE n > 0" for name in G.REGISTRY]
    return f"""WITH t AS (SELECT row_number() OVER () AS r, id, text, 0 AS n FROM {with_documents_sql(SAMPLES, 'id')}),
        l AS (SELECT r, id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t WHERE text IS NOT NULL)
        {' UNION ALL '.join(parts)}"""


def _tidy_sql() -> str:
    text = "text"
    for pattern, new in G.TIDY:
        text = f"regexp_replace({text}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return f"SELECT id, trim({text}, ' ') AS text FROM {with_documents_sql(LOOSE, 'id')} AS t"


TEXT_T = f"{with_documents_sql(TEXTS)} AS t"
SCORES = """SELECT * FROM (SELECT event_type AS detector, event_id % 900 AS base, CASE WHEN event_id % 9 = 0 THEN 'base' ELSE 'v' || event_id END AS variant, CASE event_id % 4 WHEN 0 THEN 'ALL' ELSE 'R' || (event_id % 40) END AS rule,
    CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS score, event_id, row_number() OVER (PARTITION BY event_type, event_id % 900, CASE WHEN event_id % 9 = 0 THEN 'base' ELSE 'v' || event_id END ORDER BY event_id) AS k FROM events) WHERE k = 1"""
DELTA = f"SELECT v.event_id, v.detector, v.base, v.rule, b.score - v.score AS delta FROM ({SCORES}) v JOIN ({SCORES}) b ON b.detector = v.detector AND b.base = v.base AND b.variant = 'base' WHERE v.variant <> 'base'"
DELTAS = "SELECT event_type AS detector, CAST(user_id % 7 AS VARCHAR) AS rule, CAST(CAST(round(value * 100) AS BIGINT) % 1200 - 300 AS DOUBLE) AS delta FROM events"
SIZES = f"SELECT detector, rule, sum(CAST(delta AS BIGINT)) / CAST(count(*) AS DOUBLE) AS mean, count(*) AS n FROM ({DELTAS}) GROUP BY detector, rule"
SQL = {
    "effect_size": f"SELECT *, CASE WHEN mean <= 0.5 THEN 'none' WHEN mean < 2 THEN 'weak' WHEN mean < 5 THEN 'effective' ELSE 'strong' END AS verdict FROM ({SIZES})",
    "effect_weights": f"""WITH m AS (SELECT detector, rule, CAST(floor(mean) AS BIGINT) AS mean FROM ({SIZES}) WHERE floor(mean) > 0)
        SELECT detector, rule, round_even(mean / CAST(sum(mean) OVER (PARTITION BY detector) AS DOUBLE) * count(*) OVER (PARTITION BY detector), 3) AS weight FROM m""",
    "product_lang": f"""WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) AS h, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM {TEXT_T}),
        p AS (SELECT *, CASE WHEN h > 0 AND regexp_matches(text, '[A-Za-z]+([ \\t]+[A-Za-z]+){{2,}}') THEN 'mixed' WHEN h + l = 0 OR (h >= 4 AND regexp_matches(text, '[，。！？；]|本文|研究|方法|结果|分析|探讨')) OR h / (h + l) > 0.3 THEN 'zh' ELSE 'en' END AS lang FROM c)
        SELECT doc_id, lang, CASE WHEN lang = 'zh' AND l > 0 THEN 'protected' ELSE lang END AS lane FROM p""",
    "latin_islands": f"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[\\p{{Latin}}\\x00-\\x7F]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: regexp_matches(x, '[A-Za-z]')) AS islands FROM {TEXT_T}""",
    "tidied_zh": _tidy_sql(),
    "chunks": """WITH RECURSIVE s AS (SELECT doc_id, string_split_regex(text, '(?s)```.*?(?:```|\\z)|\\$\\$.*?\\$\\$') AS a, regexp_extract_all(text, '(?s)```.*?(?:```|\\z)|\\$\\$.*?\\$\\$') AS b FROM documents),
        u AS (SELECT doc_id, 2 * i AS seg, a[i] AS text, true AS editable FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM s) UNION ALL SELECT doc_id, 2 * i + 1, b[i], false FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM s)),
        c AS (SELECT doc_id, seg, -1 AS part, '' AS text, text AS rest FROM u WHERE editable AND len(text) > 0
            UNION ALL SELECT doc_id, seg, part + 1, substr(rest, 1, cut), substr(rest, cut + 1) FROM (SELECT doc_id, seg, part, rest, CASE WHEN len(rest) <= 3500 THEN len(rest) WHEN nl > 0 THEN 3501 - nl WHEN len(sent) >= 1750 THEN len(sent) ELSE 3500 END AS cut
                FROM (SELECT doc_id, seg, part, rest, strpos(reverse(substr(rest, 1, 3500)), chr(10)) AS nl, regexp_extract(substr(rest, 1, 3500), '(?s)^(.*[.!?])\\s', 1) AS sent FROM c WHERE len(rest) > 0))),
        p AS (SELECT doc_id, seg, part, text, true AS editable FROM c WHERE part >= 0 UNION ALL SELECT doc_id, seg, 0, text, false FROM u WHERE NOT editable)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg, part) - 1 AS INT) AS chunk, text, editable FROM p""",
    "ablations": _ablation_sql(),
    "visible_chars": "SELECT doc_id, len(regexp_replace(text, '[\\s\\p{Z}\\p{Cc}\\x{AD}\\x{180E}\\x{200B}-\\x{200D}\\x{202A}-\\x{202E}\\x{2060}\\x{2066}-\\x{2069}\\x{FEFF}\\x{FE00}-\\x{FE0F}]', '', 'g')) AS n FROM documents",
    "merged_lines": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), ['本文研究了一个重要的问题并且给出了方法。', '1. 引言', 'The method is described here']), (1, []), (2, ['only line']), (3, ['- item one', '- item two'])) AS t(page, paragraphs)",
    "score_deltas": DELTA,
    "sufficiency_gate": f"""WITH d AS ({DELTA}), r AS (SELECT detector, rule, count(*) AS n FROM d WHERE rule <> 'ALL' GROUP BY 1, 2), p AS (SELECT detector, count(*) AS rules, count(*) FILTER (n < 3) AS thin FROM r GROUP BY 1),
        b AS (SELECT detector, count(DISTINCT base) AS bases, count(*) FILTER (rule = 'ALL') AS all_variants FROM d GROUP BY 1)
        SELECT b.detector, bases, all_variants, coalesce(rules, 0) AS rules, coalesce(thin, 0) AS thin, CASE WHEN bases >= 5 AND all_variants >= 5 AND coalesce(thin, 0) * 2 <= coalesce(rules, 0) THEN 'final' ELSE 'draft' END AS status FROM b LEFT JOIN p ON p.detector = b.detector""",
    "first_occurrences": f"""WITH f AS (({_spans('a', '[0-9]+')}) UNION ALL ({_spans('b', '[0-9]')})), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY start, "end", rule) AS n FROM f)
        SELECT doc_id, rule, start, "end", matched FROM r WHERE n = 1""",
    "ordered_items": """WITH RECURSIVE p AS (SELECT conv_id, turn, out, regexp_extract_all(src, '[A-Z][a-z]') AS i FROM (SELECT conv_id, turn, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS out FROM conversations) WHERE out IS NOT NULL),
        r AS (SELECT conv_id, turn, i, 0 AS k, out AS rest, true AS ok FROM p
            UNION ALL SELECT conv_id, turn, i, k + 1, substr(rest, strpos(rest, i[k + 1]) + 2), ok AND strpos(rest, i[k + 1]) > 0 FROM r WHERE k < len(i))
        SELECT conv_id, turn, ok AS ordered FROM r WHERE k = len(i)""",
    "grant_recalc_live": """SELECT o_orderkey AS grant_id, CASE WHEN o_orderstatus = 'P' OR (o_orderkey % 3 = 0 AND o_orderkey <= 900) THEN 7 ELSE CAST(greatest(0, 200 - o_orderkey % 50 - coalesce(used, 0)) AS BIGINT) END AS remaining FROM orders
        LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS used FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON l_orderkey = o_orderkey""",
    "purity": """WITH e AS (SELECT user_id % 31 AS variant, event_type AS rule, event_id FROM events), t AS (SELECT variant, min(rule) AS target FROM e GROUP BY variant),
        b AS (SELECT variant, rule, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM e GROUP BY variant, rule),
        s AS (SELECT variant, CAST(sum(CASE WHEN rule = target THEN greatest(0, a - b) ELSE 0 END) AS BIGINT) AS target_drop, CAST(sum(CASE WHEN rule = target THEN 0 ELSE abs(a - b) END) AS BIGINT) AS collateral
            FROM b JOIN t USING (variant) WHERE a + b > 0 GROUP BY variant)
        SELECT *, coalesce(target_drop / nullif(target_drop + collateral, 0), 0) AS purity FROM s""",
}
#: Without SQL: sequence matching, and all rules over whole tables (their hits are compared on fixed texts).
OPEN = (diagnose_findings, diagnose_scores, diagnose_violations, policy_findings, diff_runs, similarity_ratio, guard_compare)
QUERIES = {f.__name__: f for f in OPEN} | {name: globals()[name] for name in SQL}
