import pytest
from pyspark.sql import functions as F

from proselake.operators import autofix as A

TEXTS = ["", "Plain English stays — as it is.", "然而，研究不适用。\n**重点**内容分析。", "一句话总结：准确率为 87% [3]，研究。", "当 BERT 在 2020 年发布时，研究领域变化。", "😀 研究——方法", "说白了，**BERT** 的结果提高了 5%。"]


@pytest.mark.parametrize("text", TEXTS)
def test_edits_keep_facts_and_settle(text):
    once, log = A.codefix(text)
    assert not A.E.compare(text, once)["removed"] and A.codefix(once)[0] == once
    assert bool(log) == (once != text)
    safe, n = A.autofix(once)
    assert A.autofix(safe) == (safe, 0) and (n > 0) == (safe != once)


def test_human_text_is_untouched():
    text = "我在学校住了三年，每天骑车二十分钟去实验室，研究进展很慢。"
    assert A.codefix(text) == (text, []) and A.autofix(text) == (text, 0)


def test_long_text_without_hits_is_fast():
    import time

    began = time.time()
    assert A.autofix("学生每天读书写字。" * 13_000)[1] == 0
    assert time.time() - began < 60


def test_frames(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in A.fixed(df).collect()}
    assert got[99].text is None and got[1].text == TEXTS[1] and got[2].code_edits >= 1
    lang = df.where("text <> ''").select("doc_id", A.product_language(F.col("text")).alias("l"), A.lane(F.col("text")).alias("k"), A.islands(F.col("text")).alias("i"))
    by = {r.doc_id: r for r in lang.collect()}
    assert by[1].l == "en" and by[4].k == "protected" and "BERT" in by[4].i
    assert spark.sql("SELECT array('a', 'b') AS x, 'cab' AS t UNION ALL SELECT array('b', 'a'), 'cab'").select(A.in_order("x", "t").alias("o")).collect() == [(True,), (False,)]
