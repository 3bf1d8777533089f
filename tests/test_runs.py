"""Runs of one language inside a text."""

import random

from pyspark.sql import functions as F

from proselake.operators import autofix as A
from proselake.operators import runs as R

LINES = ["Plain English words here", "我们分析了研究结果，方法有效。", "本文研究 BERT 方法的结果。", "中文 with many English words", "12 34", "ok", "研究"]


def test_runs_like_a_loop(spark):
    rng = random.Random(3)
    texts = ["", "\n", "\n\nok", "ok\n\n\n研究", None] + ["".join(rng.choice(LINES) + "\n" * rng.randrange(4) if rng.random() < 0.9 else "\n" for _ in range(rng.randrange(12))) for _ in range(60)]
    lanes = {r.x: r.l for r in spark.createDataFrame([(x,) for x in LINES], "x string").select("x", A.lane(F.col("x")).alias("l")).collect()}
    lanes |= {r.x: r.l for r in spark.createDataFrame([(a + b,) for a in LINES for b in LINES], "x string").select("x", A.lane(F.col("x")).alias("l")).collect()}
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    done = R.edited_runs(F.col("text"), {"en": F.upper, "zh": lambda x: F.when(~x.startswith("研究"), F.concat(F.lit("<"), x, F.lit(">")))})
    got = {r.id: r for r in df.select("id", R.runs(F.col("text")).alias("runs"), done.alias("done")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].runs is None and got[i].done is None
            continue
        runs = got[i].runs
        assert "".join(r.text for r in runs) == t and [t[r.start : r.start + len(r.text)] for r in runs] == [r.text for r in runs]
        assert all(a.lane != b.lane for a, b in zip(runs, runs[1:], strict=False))
        assert all(r.lane == "raw" for r in runs if not r.text.strip("\n"))
        for r in runs:
            for line in filter(None, r.text.split("\n")):
                assert lanes.get(line, r.lane) == r.lane
        want = ""
        for r in runs:
            core = r.text.rstrip("\n")
            new = core.upper() if r.lane == "en" else f"<{core}>" if r.lane == "zh" and not core.startswith("研究") else core
            want += (new if r.lane != "raw" else core) + r.text[len(core) :]
        assert got[i].done == want


def plain_flat(text):
    import re

    n, out = 0, []
    for para in text.split("\n"):
        if not para.strip():
            out.append(para)
            continue
        parts = []
        for s in filter(str.strip, re.split("(?<=[。！？])", para)):
            at = s.rfind("，", 0, len(s) // 2 + 10)
            parts += [s[:at] + "。", s[at + 1 :]] if len(s) > 45 and at > 12 else [s]
            n += len(s) > 45 and at > 12
        done, held = "", ""
        for s in parts:
            if len(s) < 18:
                held, n = held + s.rstrip("。！？") + "，", n + 1
            else:
                done, held = done + (held.rstrip("，") + "。" if held else "") + s, ""
        out.append(done + (held.rstrip("，") + "。" if held else ""))
    return "\n".join(out), n


def test_flattened_like_a_loop(spark):
    from proselake.functions import transforms as G

    rng = random.Random(5)
    texts = ["", "\n \n", "短。", "甲" * 50 + "，乙。", "甲" * 20 + "，" + "乙" * 40 + "。短！"]
    texts += ["".join(rng.choice(["字" * rng.randrange(1, 30), "，", "。", "！", "\n", " "]) for _ in range(rng.randrange(40))) for _ in range(150)]
    text, n = G.flattened(F.col("text"))
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "id long, text string").select("id", text.alias("text"), n.alias("n"))
    got = {r.id: (r.text, r.n) for r in df.collect()}
    assert got.pop(999) == (None, 0)
    assert got == {i: plain_flat(t) for i, t in enumerate(texts)}
    assert sum(x for _, x in got.values()) > 200


def test_a_line_is_judged_once(spark):
    lines = ["", " ", "abc", "12.", "abc def ghi", "研究方法", "研究 BERT", "研究 one two three 方法", "abcdefgh 研", "é", "é à", "。", "a\r", "\r", "x\u2028", "甲乙丙丁。", "\u0130k"]
    df = spark.createDataFrame([("\n".join([a, b] * 2),) for a in lines for b in lines], "t string")
    lane = lambda x: A.lane(F.regexp_replace(x, r"\n+$", ""))
    want = F.transform(F.filter(F.split("t", "\n", -1), lambda x: x != ""), lane)
    told = F.transform(F.filter(F.regexp_extract_all("t", F.lit(r"[^\n]+\n*|\n+"), F.lit(0)), lambda x: ~x.startswith("\n")), R._lane)
    assert df.where(want != told).count() == 0
    plan = df.select(R.edited_runs(F.col("t"), {"en": F.upper, "zh": F.lower}).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z]+(?:") == 1
