"""Numbers as values, whatever way they are written."""

import random

from pyspark.sql import functions as F

from proselake.functions import numbers as N

SAME = [
    ["3.20 mg", "3.2mg", "03.200 mg"], ["1e-3", "0.001", "10^-3", "10⁻³", "1×10⁻³", "1 x 10^-3", "1E−3"], ["1,000 kg", "1000 kg", "1e3 kg"], ["p < 0.05", "P<.05", "p <0.050"], ["0", "-0.0", "0e7"],
    ["二十五人", "25人", "25.0 人"], ["两千零五年", "2005年", "二〇〇五年"], ["三万五千元", "35000元", "35,000 元"], ["一亿二千万次", "1.2e8次"], ["十二万三千四百五十六人", "123456人"], ["一百二十三万亿元", "1.23e14元"],
]
OTHER = [("3.2 mg", "-3.2 mg"), ("10 mg", "10 kg"), ("10 ℃", "10 ℉"), ("p < 0.05", "p > 0.05"), ("p < 0.05", "0.05"), ("1st", "1"), ("第三", "三人"), ("10^3", "10^4"), ("2^3", "8"), ("5 5", "5"), ("5%", "5‰"), ("二十", "十二")]


def test_equal_and_unequal_numbers(spark):
    rows = [(a, b, True) for group in SAME for a in group for b in group] + [(a, b, False) for a, b in OTHER] + [("", "none", True), (None, "", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", N.same_numbers(F.col("a"), F.col("b")))
    assert [(r.a, r.b) for r in df.collect() if r.got != r.want] == []


def test_where_numbers_begin(spark):
    texts = {"x5 v2.0.1 PeMS04 a_7": [], "3-5 cells, (-4) and +6": ["3", "5 cells", "-4", "+6"], "统一 一 十": [], "第一章": ["第一"], "1,2,3 and 1,000": ["1", "2", "3 and", "1,000"], "22nd of 3rd": ["22nd", "3rd"]}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.transform(N.atoms(F.col("t")), lambda x: x["written"]).alias("w"))
    assert {r.t: r.w for r in df.collect()} == texts


def test_chinese_numerals_count(spark):
    rng = random.Random(9)

    def written(n):
        digits, small, out = "零一二三四五六七八九", ["", "十", "百", "千"], []
        for k, big in ((8, "亿"), (4, "万"), (0, "")):
            part, text, zero = n // 10**k % 10**4, "", False
            for i in (3, 2, 1, 0):
                d = part // 10**i % 10
                zero = zero or (d == 0 and bool(text or out))
                if d:
                    text += ("零" if zero and (text or out) else "") + digits[d] + small[i]
                    zero = False
            if text:
                out.append(text + big)
        return "".join(out) or "零"

    numbers = [rng.randrange(10 ** rng.randrange(2, 13)) for _ in range(300)] + [10, 100, 10_000, 10**8, 10_010, 100_100_000, 2_000_300]
    df = spark.createDataFrame([(n, written(n)) for n in numbers], "n long, t string").withColumn("v", N.chinese_value(F.col("t")).cast("long"))
    assert [(r.n, r.t, r.v) for r in df.collect() if r.n != r.v] == []
