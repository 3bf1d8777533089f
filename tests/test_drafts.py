"""Drafts, guards and model requests that no SQL can say."""

import pytest
from pyspark.sql import functions as F

from proselake.operators import drafts as A
from proselake.operators import operations as O
from proselake.operators import review as V


def test_packs_hold_every_paragraph():
    paras = ["a" * n for n in (10, 3000, 3000, 9000, 1, 5998, 2)]
    got = A.pack(paras)
    assert "\n\n".join(got).split("\n\n") == paras and got[2] == paras[3] and A.pack([]) == []


@pytest.mark.parametrize(
    ("source", "output", "code"),
    [
        ("第一段说明了研究方法。\n第二段给出了分析结果。", "第一段说明了研究方法。\n第二段给出了分析结果。", 0),
        ("第一段说明了研究方法。\n第二段给出了分析结果。", "第一段说明了研究方法。\n\n第二段给出了分析结果。", -8500),
        ("甲组同学负责数据训练。乙组写作。\n丙组同学负责系统部署。", "乙组写作。\n丙组同学负责系统部署。甲组同学负责数据训练。", -8475),
        ("有内容。\n末段。", " \n末段。", -8450),
        ("公式 $a+b$ 在此。", "公式 $a-b$ 在此。", -8400),
        ("准确率为87%。", "准确率为90%。", -8300),
    ],
)
def test_paragraph_safety(source, output, code):
    assert A.paragraph_safety(source, output)[0] == code


def test_local_changes_see_swapped_bindings():
    assert A.local_changes("A is 10, B is 20.", "A is 10, B is 20.") == []
    swapped = A.local_changes("A is 10, B is 20.", "A is 20, B is 10.")
    assert swapped and any("number bound otherwise" in r for _, _, r in swapped)
    turned = A.local_changes("2 teachers influence students", "students influence 2 teachers")
    assert any("order changed" in r for _, _, r in turned)
    assert A.local_changes("It has 3 parts.", "") == [("It has 3 parts", "", ["missing"])]


def test_document_guard():
    same = A.document_guard("我们用 BERT 得到 87%。", "我们用 BERT 得到 87%。")
    assert not same["blocked"] and not same["latin"]
    assert A.document_guard("我们用 BERT 得到 87%。", "我们用 bert 得到 87%。")["latin"]
    assert A.document_guard("It may work.", "It works.")["blocked"]


def test_completions(spark):
    class Shy(A.Echo):
        def complete(self, system, user, n=1):
            if n > 1:
                raise TypeError("one at a time")
            if "fail" in user:
                raise ValueError("down")
            return super().complete(system, user, n)

    df = spark.createDataFrame([(1, "s", "x <<<TEXT>>> body <<<END>>> y"), (2, "s", "fail"), (3, None, None)], "id int, system string, user string")
    got = {r.id: r for r in A.completions(df, lambda: Shy(str.upper), n=2).collect()}
    assert got[1].outputs == ["BODY", "BODY"] and got[2].outputs is None and got[2].error == "down" and got[3].outputs == ["", ""]
    assert A.completions(df.where("false"), A.Echo).count() == 0


def test_empty_frames(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.bilingual_findings(docs).count() == 0 == A.bilingual_report(docs).count()
    found = spark.createDataFrame([], "doc_id long, rule string, start int, end int, matched string, severity string, handling string, category string, lang string, para int")
    for df in (V.issues(found, "safe"), V.safe_cleanups(found), V.rewrite_targets(found, ["A"]), A.prompt_items(found), V.desk_findings(found, docs)):
        assert df.count() == 0
    jobs = spark.createDataFrame([], "job_id long, state string, queued_at long")
    assert O.recover(jobs, jobs).count() == 0 and O.oldest_queued(jobs.withColumn("k", F.lit(1)), "k").count() == 0
    assert O.newest_archive(spark.createDataFrame([], "path string, modified long, length long"), 0, 1).count() == 0


def test_two_layers(spark):
    docs = spark.createDataFrame([(1, "**重点**内容。说白了，研究有效。"), (2, "Plain English."), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in A.two_layers(docs).collect()}
    assert got[1].after < got[1].before and got[1].code_edits + got[1].safe_edits > 0 and got[2].before == got[2].after


def test_autofix_bilingual():
    assert A.autofix_bilingual("**Bold** BERT 模型，研究。") == ("Bold BERT 模型，研究。", 1)
    assert A.autofix_bilingual("Plain text.") == ("Plain text.", 0)
