"""The prose rules and the 31 checks over fixed sentences, and SQL that counts the same hits.

Each text is one sentence and one paragraph, so sentence, paragraph and whole-text rules see the same characters. What needs a look
behind or ahead, or a count over sentences, has its expected hits written down.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import rules as T
from ..operators import diagnose as D
from ..operators import prose as P
from .review_queries import OWN_ROWS, values, with_documents, with_documents_sql

ZH = [
    "保证了数据安全性、隐私性和可靠性，研究。",
    "他不仅提升了效率，更是改变了行业。",
    "这不只是工具而是方法的更新。",
    "并非所有人都同意而是多数人反对该方案。",
    "作为经济发展的重要支撑，本研究分析了制造业。",
    "该平台扮演着连接双方的角色，结果稳定。",
    "它发挥着重要枢纽的作用，分析如下文。",
    "产量上升，从而凸显了投入的价值。",
    "通过问卷和访谈实现了数据收集的目标。",
    "围绕三个问题展开分析与讨论。",
    "研究表明结果可靠，专家指出仍有不足。",
    "该成果具有重要意义，前景广阔。",
    "为后续工作提供了有益的参考，奠定了坚实的基础。",
    "这似乎可能有效，方法简单。",
    "在一定程度上可能或许有效，结果待定。",
    "实现了全部目标，方法有效。",
    "然而，研究结果并不稳定。",
    "核心在于：方法是否可靠。",
    "它就像一位经验丰富的导师，陪伴学生。",
    "当所有人都在写作时，内容不同。",
    "当他在写作的时候时，结果不同。",
    "对于初学者来说，方法不难。",
    "在数据处理方面，结果较好。",
    "这意味着研究需要更多样本。",
    "说白了，预算不足，研究停了。",
    "基于社会认同理论，本文分析了用户行为。",
    "由此可见，方法有效。",
    "失败的原因主要有三种：",
    "值得注意的是，样本量只有十二。",
    "答案——专注，研究方法。",
    "答案--专注，研究方法。",
    "分隔---之后，研究方法。",
    "这是**重点**内容，研究方法。",
    "他说\"可以\"，研究方法。",
    "我在学校住了三年，每天骑车二十分钟去实验室，进展很慢。",
    "准确率为87%，召回率为62%，样本为1200条。",
    "这是一个能够帮助大家快速完成各种日常工作任务的工具，研究。",
    "- 列表项目，研究方法。",
    "一、方法\n二、结果\n三、讨论",
]
#: (text, rule, hits) that SQL is not asked to count.
ZH_EXPECTED = [(0, "S01", 1), (18, "L03", 1), (19, "L05", 1), (29, "F01", 1), (30, "F01", 1), (31, "F01", 1), (38, "S02", 3)]
EN = [
    "It is fast, simple, and robust.",
    "We thank Alice Chen, Bob Li, and Carol Wang for help.",
    "It is not just fast but also cheap.",
    "They chose trains rather than short flights.",
    "It serves as a base and functions as a bridge.",
    "This represents a change and refers to the past.",
    "It grew, highlighting the need for care.",
    "It rose, contributing to the total, reflecting demand.",
    "Experts argue so, and some suggest more.",
    "Studies show that it is widely believed.",
    "It plays a vital role, paving the way.",
    "This underscores the importance of data.",
    "It arguably appears to work.",
    "It arguably works.",
    "It seems to be somewhat relatively new.",
    "It was found that water boils.",
    "According to Smith (2020) it works.",
    "Firstly a, secondly b.",
    "On the one hand a, on the other hand b.",
    "Overall, it works.",
    "Future work should test it.",
    "Despite these challenges it faces several challenges.",
    "I rode my bike to the lab for three years.",
    "The sample had 1200 rows and 14 columns.",
]
EN_EXPECTED = [(0, "S01", 1)]
POLICY = [
    "不仅是工具的更新，更是方法的改变。",
    "学校就是知识的桥梁。",
    "接下来让我们一起看看结果。",
    "值得注意的是，样本很小。",
    "苹果、香蕉和橘子都在桌上。",
    "他说——可以——就走了。",
    "人工智能—深度学习—强化学习是主题。",
    "这项工作至关重要，我们深入探讨了原因。",
    "这标志着公司进入新时代。",
    "它与经济有着密切联系。",
    "产量上升，从而彰显了不懈的精神。",
    "这里堪称美食爱好者的天堂梦想天堂。",
    "专家认为效果很好，研究表明也是。",
    "作为社会的重要载体，它发挥着枢纽作用。",
    "好问题！希望这对你有所帮助。",
    "由于资料有限，无法给出结论。",
    "这一段是刚刚补充的。",
    "这是我的朋友的同学的老师的书。",
    "我们进行了全面的分析，他们进行讨论。",
    "风和日丽、鸟语花香、山清水秀的日子。",
    "在互联网快速发展的时代背景下，教育在变。",
    "让我们拭目以待未来的变化。",
    "这**一点**很要紧，那**两点**也是。",
    "他说\"可以\"就走了。",
    "他被批评，又被表扬，还被奖励。",
    "他被批评，又被表扬。",
    "这似乎可能有效。",
    "好的。行的。对的。",
    "研究很长的一句话在这里。研究很长的第二句在这里。研究很长的第三句在这里。",
    "标题文字\n标题文字说的是同一件事。",
    "🔥 要点在此处写明。",
    "`**代码**` 之外没有别的。",
]
#: (text, check, hits) of checks that runs of sentences, lines or counts decide.
POLICY_EXPECTED = [(24, "B11", 1), (24, "F28", 1), (25, "B11", 1), (26, "B9", 1), (27, "A2", 1), (28, "B7", 1), (29, "E24", 1)]
#: Checks by pattern that SQL counts; D20 matches at line starts, B6 to F29 overlap by design.
LATER = {"A2", "B7", "B9", "B11", "E24", "F28"}


def _texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def _hits(found, name: str):
    return found.groupBy("doc_id", F.col(name).alias("rule")).agg(F.count("*").alias("hits"))


def _everywhere(spark, d, rows):
    """Hits of all rules over own rows and over all documents; what a finder decides (English S01) is compared over own rows only."""
    found = D.diagnose(with_documents(spark, d, rows)).where("rule NOT LIKE 'V-%'")
    return _hits(found.where((F.col("doc_id") < OWN_ROWS) | ~((F.col("lang") == "en") & (F.col("rule") == "S01"))), "rule")


def rule_hits_zh(spark, d):
    return _everywhere(spark, d, ZH)


def rule_hits_en(spark, d):
    return _everywhere(spark, d, EN)


def policy_hits(spark, d):
    return _hits(D.policy(_texts(spark, POLICY)), "check")


def _scored(spark, rows):
    t = _texts(spark, rows)
    found = D.diagnose(t).where("rule NOT LIKE 'V-%'")
    return found, D.scores(found, P.paragraph_segments(t))


def rule_scores_zh(spark, d):
    return _scored(spark, ZH)[1]


def rule_scores_en(spark, d):
    return _scored(spark, EN)[1]


def rule_violations(spark, d):
    return D.violations(*_scored(spark, ZH[:38]))


def _count(rule: str, pattern: str) -> str:
    return f"SELECT doc_id, '{rule}' AS rule, len(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')) AS hits FROM t"


def _hedges(words: list[str], column: str) -> str:
    seen = " + ".join(f"(len({column}) - len(replace({column}, '{w}', ''))) // {len(w)}" for w in words)
    return f"SELECT doc_id, 'S09' AS rule, CASE WHEN {seen} >= 2 THEN 1 ELSE 0 END AS hits FROM t"


def _sql(texts: list[str], rules: dict[str, str], expected: list[tuple], more: list[str] = (), everywhere: bool = False) -> str:
    parts = [_count(rule, p) for rule, p in rules.items() if rule not in {r for _, r, _ in expected}] + list(more)
    parts.append(f"SELECT * FROM (VALUES {values(expected)}) AS x(doc_id, rule, hits)")
    source = with_documents_sql(texts) if everywhere else f"(VALUES {values(enumerate(texts))})"
    return f"WITH t(doc_id, text) AS (SELECT * FROM {source}) SELECT CAST(doc_id AS BIGINT) AS doc_id, rule, CAST(hits AS BIGINT) AS hits FROM ({' UNION ALL '.join(parts)}) WHERE hits > 0"


def _patterns(rows) -> dict[str, str]:
    return {r.rule: r.pattern for r in rows if not r.pattern.startswith("=")}


SQL = {
    "rule_hits_zh": _sql(ZH, _patterns([*T.ZH, *T.FORMAT]), ZH_EXPECTED, [_hedges(L.HEDGES_ZH, "text")], everywhere=True),
    "rule_hits_en": _sql(EN, _patterns(T.EN), EN_EXPECTED, [_hedges(L.HEDGES_EN, "lower(text)")] + [_count(r, p) for r, p in _patterns(T.FORMAT).items() if r != "F01"], everywhere=True),
    "policy_hits": _sql(POLICY[:31], {c.check: c.pattern for c in T.POLICY if c.pattern and c.check not in LATER}, POLICY_EXPECTED),
}


def _scores_sql(name: str, texts: list[str], rules) -> str:
    """Scores of texts of one paragraph, from the hits of their sentence and paragraph rules."""
    own = values((r.rule, r.weight) for r in rules)
    return f"""WITH h AS (SELECT h.*, w FROM ({SQL[name]}) h JOIN (VALUES {own}) AS r(name, w) ON rule = name), t(doc_id, text) AS (VALUES {values(enumerate(texts))}),
        p AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS para FROM t),
        s AS (SELECT doc_id, list_sort(list(DISTINCT rule)) AS rules, sum(hits * w) AS w FROM h GROUP BY 1)
        SELECT p.doc_id, para, coalesce(rules, []) AS hit_rules, 0 AS vocab_hits, CAST(coalesce(len(rules), 0) AS INT) AS raw_score, CAST(coalesce(w, 0) AS DOUBLE) AS weighted,
            CASE WHEN len(rules) >= 4 THEN 'high' WHEN len(rules) >= 2 THEN 'medium' ELSE 'low' END AS level FROM p LEFT JOIN s ON s.doc_id = p.doc_id"""


SQL |= {
    "rule_scores_zh": _scores_sql("rule_hits_zh", ZH, T.ZH),
    "rule_scores_en": _scores_sql("rule_hits_en", EN, T.EN),
    "rule_violations": f"""WITH l(name, most) AS (VALUES {values(T.DOCUMENT_LIMITS.items())}), h AS ({SQL['rule_hits_zh']})
        SELECT doc_id, rule, CAST(hits AS DOUBLE) AS actual, CAST(most AS DOUBLE) AS "limit", CAST(NULL AS INT) AS para FROM h JOIN l ON name = rule WHERE hits > most AND doc_id < 38
        UNION ALL SELECT doc_id, rule, 1.0, CAST({T.SHARE_LIMITS['P01']} AS DOUBLE), NULL FROM h WHERE rule = 'P01' AND doc_id < 38""",
}
QUERIES = {name: globals()[name] for name in SQL}
