import random
import re
import time

import pytest
from pyspark.sql import functions as F

from proselake.functions import lexicon as L
from proselake.functions import rules as T
from proselake.operators import diagnose as D
from proselake.operators import prose as P

ZH = "本研究具有重要意义。专家认为，该方法不仅提升了效率，更是改变了行业格局。\n然而，似乎在一定程度上可能有效，从而凸显了价值。\n综上所述，前景广阔。"
EN = "It was found that studies show the method is not just fast but also cheap. Experts argue it plays a crucial role.\nThe design is fast, simple, and robust for users. Overall, this delves into a tapestry."


@pytest.mark.parametrize(
    ("rule", "text"),
    [("S03", "他不仅提升了效率，更是改变了行业。"), ("S07", "研究表明结果可靠。"), ("S08", "该成果具有重要意义。"), ("S09", "这似乎可能有效。"), ("L05", "当所有人都在写作时，内容不同。"), ("L09", "说白了，预算不足。"), ("P02", "由此可见，方法有效。"), ("L07", "此外，研究分析了结果。"), ("L02", "失败的原因主要有三种："), ("F01", "答案——专注，研究方法。"), ("S01", "保证了数据安全性、隐私性和可靠性，研究。")],
)
def test_zh_rules_fire(rule, text):
    assert rule in {f[0] for f in D.diagnose_text(text, D.toolkit())}


@pytest.mark.parametrize(
    ("rule", "text"),
    [("S01", "It is fast, simple, and robust."), ("S03", "It is not just fast but also cheap."), ("S04", "It serves as a base."), ("S05", "It grew, highlighting the need."), ("S07", "Experts argue so."), ("S08", "It plays a vital role."), ("S09", "It arguably appears to work."), ("S11", "It was found that x."), ("S12", "According to Smith (2020) it works."), ("S02", "Firstly a, secondly b."), ("P02", "Overall, it works."), ("P03", "Future work should test it.")],
)
def test_en_rules_fire(rule, text):
    assert rule in {f[0] for f in D.diagnose_text(text, D.toolkit())}


def test_author_lists_are_no_rule_of_three():
    assert not list(D.rule_of_three("We thank Alice Chen, Bob Li, and Carol Wang for help."))


def test_offsets_slice_back_and_longest_term_wins():
    for text in (ZH, EN):
        for f in D.diagnose_text(text, D.toolkit()):
            assert text[f[7] : f[8]] == f[9]
    hits = list(D.Vocabulary("zh").find("这充分说明了问题"))
    assert [h[2] for h in hits] == ["T1"]


def test_scores_and_violations(spark):
    docs = spark.createDataFrame([(1, ZH), (2, EN), (3, None), (4, "")], "doc_id long, text string")
    found = D.diagnose(docs).cache()
    assert {r.doc_id for r in found.collect()} == {1, 2}
    scored = D.scores(found, P.paragraph_segments(docs))
    by = {(r.doc_id, r.para): r for r in scored.collect()}
    assert len(by) == 5 and by[1, 0].raw_score >= 3 and by[1, 0].level in ("medium", "high")
    broken = {(r.doc_id, r.rule) for r in D.violations(found, scored).collect()}
    assert {(1, "S08"), (1, "S07"), (2, "S07"), (2, "S08")} <= broken


def test_policy_and_safe_edits(spark):
    text = "# ✨ 标题\n**重点**内容。`**代码**`\n他被批评，又被表扬，还被奖励。短句。短句。短句。"
    found = D.policy_text(text)
    assert {"D19", "D20"} & {f[0] for f in found} and {"A2", "B7", "B11", "F28"} <= {f[0] for f in found}
    assert all(text[f[3] : f[4]] == f[5] for f in found)
    assert "`**代码**`" in D.apply_safe(text, found) and "**重点**" not in D.apply_safe(text, found)
    once = D.apply_safe(text, found)
    assert D.apply_safe(once, D.policy_text(once)) == once
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert D.policy(docs).count() == len(found)


def test_registry():
    assert len(T.ZH) + len(T.FORMAT) == 27 and len(T.EN) == 12 and len(T.POLICY) == 31
    assert all(r.handling in ("code", "llm", "report") for r in [*T.ZH, *T.EN, *T.FORMAT])
    assert len(L.T1_ZH) == 60 and len(L.T2_ZH) == 49 and len(L.T3_ZH) == 31


def test_language_like_columns(spark):
    from proselake.functions import text as X

    texts = [ZH, EN, "", "123", "中文 with mostly English words here", "本文使用 BERT GPT Transformer ResNet"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.lang for r in df.select("i", X.language(F.col("text")).alias("lang")).collect()}
    assert got == {i: D.language(t) for i, t in enumerate(texts)}


def test_policy_matches_like_the_patterns():
    rng = random.Random(4)
    from proselake.plans.rule_queries import POLICY

    words = [*POLICY, "——", "--", "-", "、", "，", "。", "\n", "a", "一", "不仅", "而是", "的", "背景下", "是", "**", "研究"]
    for _ in range(400):
        text = "".join(x[(k := rng.randrange(len(x) + 1)) : k + rng.randrange(1, 60)] if rng.random() < 0.5 else x for x in rng.choices(words, k=rng.randrange(1, 12)))
        want = {(c.check, *m.span()) for c in T.POLICY if c.pattern for m in re.finditer(c.pattern, text)}
        assert {(check, *m.span()) for check, m in D.policy_matches(text)} == want


def test_time_follows_long_lines():
    def seconds(n):
        text = "word -- " + "ward " * n
        t = time.perf_counter()
        assert D.policy_text(text) == []
        return time.perf_counter() - t

    seconds(100)
    assert seconds(40_000) < 20 * max(seconds(4_000), 0.005)


def test_rules_that_are_left_out_match_nothing():
    from proselake.plans import rule_queries as Q

    rng, kit = random.Random(8), D.toolkit()
    words = [*Q.EN, *Q.ZH, EN, ZH, "K ſome reſearch ſhowſ ", "It İs NOT JUST fast but ", " It ıs belIeved ", " arguably ", "\n", ". ", "。"]
    left_out = 0
    for _ in range(400):
        parts = (x if rng.random() < 0.6 else rng.choice([x.upper(), x[rng.randrange(len(x)) :]]) for x in rng.choices(words, k=rng.randrange(1, 4)))
        text = "".join(parts)
        able = D._possible(text, kit)
        for k, rules in able.items():
            for rule, find in kit[k]:
                if rule not in [r for r, _ in rules]:
                    left_out += 1
                    assert not list(find(text)) and not any(list(find(text[a:b])) for a, b in D.sentences(text, k[1])), (text, rule)
    assert left_out > 1000


def test_time_of_texts_without_hits():
    text = "Wolen garu teb miso lanter foud. " * 6000
    kit = D.toolkit()
    D.diagnose_text(text, kit)
    t = time.perf_counter()
    every = {k: v for k, v in kit.items()}
    for rule, find in (x for k in (("sentence", "en"), ("paragraph", "en")) for x in every[k]):
        for a, b in D.sentences(text, "en"):
            list(find(text[a:b]))
    whole = time.perf_counter() - t
    t = time.perf_counter()
    assert D.diagnose_text(text, kit) == []
    assert time.perf_counter() - t < whole
