import random

import pytest
from pyspark.sql import functions as F

from proselake.operators import edits as E
from proselake.operators import effects, relational
from proselake.streaming import state as S

CASES = [("Hello, world's end", 3), ("中文 text 123", 4), ("don't stop", 2), ("a-b", 2), ("A\u200bB", 1), ("e\u0301t", 1), ("かな😀", 3), ("", 0), ("…—!", 0)]


@pytest.mark.parametrize(("text", "units"), CASES)
def test_units(text, units):
    assert E.billable_units(text)["total"] == units


def test_chunks_concatenate():
    text = ("句子一。" * 400 + "\n") * 3 + "```code\n" + "x" * 5000 + "```" + "tail. " * 900
    got = E.chunks(text)
    assert "".join(t for t, _ in got) == text and all(len(t) <= E.CHUNK or not e for t, e in got)
    assert E.chunks("") == []


@pytest.mark.parametrize(("a", "b"), [("the cat sat", "the dog sat down"), ("", "x"), ("中文文本", "中英文本"), ("same", "same"), ("x" * 3000, "y " * 3000)])
def test_diff_rebuilds(a, b):
    runs = E.diff_runs(a, b)
    assert "".join(t for k, t in runs if k != "added") == a and "".join(t for k, t in runs if k != "removed") == b


def test_guard():
    assert E.compare("Accuracy rose to 87% [3].", "Accuracy rose to 87% [3].") == {"added": [], "removed": [], "semantic": []}
    assert "number:90%" in E.compare("It is 87%.", "It is 90%.")["added"]
    assert "negation" in E.compare("It does not work.", "It does work.")["semantic"]
    assert "correlation->causation" in E.compare("A correlates with B.", "A causes B.")["semantic"]
    assert E.bounds("不少于5, more than 3, at most 2") == [">=", ">", "<="]
    assert E.pick("It is 87% good.", ["", "It is 90% good.", "It is 87% fine."], [1, 1, 1]) == 2
    assert E.pick("It is 87% good.", ["It is 90% good."], [5]) is None
    assert [x[:2] for x in E.align("a one, b two. c three", "a one, b two. c three")] == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize(
    ("source", "output", "kind"),
    [
        ("The drug may help patients.", "The drug helps patients.", "uncertainty"),
        ("The port does not accept ships.", "The port accepts ships.", "negation"),
        ("The port can’t accept ships.", "The port can accept ships.", "negation"),
        ("Sleep is correlated with memory.", "Sleep causes memory.", "correlation->causation"),
        ("They plan to open the bridge.", "They opened the bridge.", "planned"),
        ("The maps will be published.", "The maps were published.", "planned"),
        ("If the light is green, cars go.", "The light is green, cars go.", "condition"),
        ("It holds at least 40 seats.", "It holds at most 40 seats.", "bounds"),
        ("All guests must sign.", "Some guests must sign.", "universal"),
        ("Guests must sign.", "Guests should sign.", "obligation"),
        ("The dam is higher than the tower.", "The dam is lower than the tower.", "higher"),
        ("Only members can vote.", "Members can vote.", "only"),
        ("该药可能有效。", "该药有效。", "uncertainty"),
        ("该平台不对公众开放。", "该平台对公众开放。", "negation"),
        ("产量超过3000吨。", "产量等于3000吨。", "bounds"),
        ("睡眠与记忆相关。", "睡眠导致记忆。", "correlation->causation"),
        ("当 x > 3 时成立。", "当 x < 3 时成立。", "signs"),
    ],
)
def test_guard_blocks(source, output, kind):
    assert kind in E.compare(source, output)["semantic"]


@pytest.mark.parametrize(
    ("source", "output"),
    [
        ("The drug may help patients.", "The drug might help patients."),
        ("The port does not accept ships.", "The port never accepts ships."),
        ("Sleep is correlated with memory.", "Sleep is associated with memory."),
        ("They plan to open the bridge.", "They intend to open the bridge."),
        ("It holds at least 40 seats.", "It holds no less than 40 seats."),
        ("All guests must sign.", "Every guest is required to sign."),
            ("该药可能有效。", "该药或许有效。"),
    ],
)
def test_guard_allows(source, output):
    assert E.compare(source, output)["semantic"] == []


def test_udfs(spark):
    E.register(spark)
    df = spark.createDataFrame([("a b", "a c"), (None, "x")], "a string, b string")
    got = df.select(E.diff_runs_udf("a", "b").alias("d"), E.similarity_udf("a", "b").alias("s"), E.chunks_udf("a").alias("c"), E.compare_udf("a", "b").alias("g")).collect()
    assert got[0].s > 0.5 and got[1].s == 0 and got[1].c == []
    assert spark.sql("SELECT billable_units('中 a').total AS t, visible_chars(' ab ') AS v").first()[:] == (2, 2)


def test_effects(spark):
    before = spark.createDataFrame([("v1", "A", 3), ("v1", "B", 1), ("v2", "A", 2)], "variant string, rule string, n long")
    after = spark.createDataFrame([("v1", "B", 2), ("v2", "A", 2)], "variant string, rule string, n long")
    target = spark.createDataFrame([("v1", "A"), ("v2", "A")], "variant string, target string")
    got = {r.variant: r.purity for r in effects.purity(before, after, target).collect()}
    assert got == {"v1": 0.75, "v2": 0.0}
    rows = [("d", "b1", "base", "", 90.0, 1.0, 0), ("d", "b1", "x", "A", 80.0, 1.0, 2), ("d", "b1", "y", "B", 89.0, 1.0, 1), ("d", "b1", "z", "C", 95.0, 0.1, 1)]
    delta = effects.deltas(spark.createDataFrame(rows, "detector string, base string, variant string, rule string, score double, purity double, n_changes int"))
    sizes = effects.effect_sizes(delta)
    assert {r.rule: (r["mean"], r.verdict) for r in sizes.collect()} == {"A": (10.0, "strong"), "B": (1.0, "weak")}
    weights = {r.rule: r.weight for r in effects.effect_weights(sizes).collect()}
    assert weights == {"A": 1.818, "B": 0.182} and effects.sufficiency(delta).first().status == "draft"


ORDERS = [
    ("e1", "o1", "refund", "succeeded", 30, "r1"), ("e2", "o1", "payment", "paid", 100, None), ("e2", "o1", "payment", "paid", 100, None), ("e2", "o1", "payment", "paid", 999, None),
    ("e3", "o2", "payment", "expired", 0, None), ("e4", "o2", "payment", "paid", 50, None), ("e5", "o2", "refund", "succeeded", 50, "r2"), ("e6", "o2", "refund", "failed", 50, "r2"),
    ("e7", "o3", "payment", "failed", 0, None), ("e8", "o4", "payment", "paid", 20, None), ("e9", "o4", "refund", "succeeded", 20, "r3"),
]


def test_order_stream_equals_batch(spark, tmp_path):
    rows = [(*r[:6], None) for r in ORDERS]
    df = spark.createDataFrame(rows, S.ORDER_EVENTS).withColumn("ts", F.timestamp_seconds(F.expr("cast(substring(event_id, 2) as long)")))
    want = {r.order_id: r.asDict() for r in S.orders_batch(df).collect()}
    assert want["o1"] == {"order_id": "o1", "status": "partially_refunded", "amount": 100, "refunded": 30, "duplicates": 1, "conflicts": 1}
    assert [want[k]["status"] for k in ("o2", "o3", "o4")] == ["paid", "failed", "refunded"]
    src = str(tmp_path / "src")
    for lo, hi in ((1, 2), (3, 5), (6, 9)):
        df.where(F.expr(f"cast(substring(event_id, 2) as int) between {lo} and {hi}")).coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "out")
    q = S.orders_stream(S.read_events(spark, src, S.ORDER_EVENTS)).writeStream.foreachBatch(S.upsert(spark, out, ["order_id"])).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    last = sorted((tmp_path / "out").glob("v=*"), key=lambda p: int(p.name[2:]))[-1]
    got = {r.order_id: r.asDict() for r in spark.read.parquet(str(last)).collect()}
    assert {k: v["status"] for k, v in got.items()} == {k: v["status"] for k, v in want.items()}


def test_orders_batch_is_the_fold_and_runs_no_python(spark):
    base = [(*r, i // 2) for i, r in enumerate(ORDERS)]
    more = [(f"n{i}", f"o{i % 9}", "refund" if i % 3 else "payment", ("succeeded", "failed", "paid", "expired")[i % 4 if i % 3 else 2 + i % 2], i % 5 * 10 + 10, f"r{i % 2}" if i % 3 else None, 50 - i) for i in range(45)]
    df = spark.createDataFrame(base + more, "event_id string, order_id string, kind string, status string, amount long, ref string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    out = S.orders_batch(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and plan.count("Exchange ") == 1
    held = {}
    for r in sorted(base + more, key=lambda r: (r[6], r[0])):
        held.setdefault(r[1], []).append((r[0], *r[2:6]))
    assert {r.order_id: r.asDict() for r in out.collect()} == {k: S.order_row(k, S.fold_order(v)) for k, v in held.items()}


def test_upsert_keeps_the_newest_row_and_few_versions(spark, tmp_path):
    out = str(tmp_path / "up")
    write = S.upsert(spark, out, ["k"], order="ts", keep=2)
    for epoch, rows in enumerate([[("a", 1, 1), ("a", 2, 3), ("a", 3, 2)], [("b", 4, 1)], [("a", 5, 9)], [("a", 5, 9)], [("c", 6, 1)]]):
        write(spark.createDataFrame(rows, "k string, v int, ts int"), epoch)
    write(spark.createDataFrame([("c", 6, 1)], "k string, v int, ts int"), 4)
    versions = sorted(int(p.name[2:]) for p in (tmp_path / "up").glob("v=*"))
    assert versions[-1] == 4 and len(versions) <= 3
    assert sorted(map(tuple, spark.read.parquet(f"{out}/v=4").collect())) == [("a", 5, 9), ("b", 4, 1), ("c", 6, 1)]


def test_traffic_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "src")
    events.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(src)
    q = S.traffic_stream(S.read_events(spark, src)).writeStream.format("memory").queryName("views").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(100)
    got = {(r.day, r.route): r.views for r in spark.table("views").collect()}
    assert got == {(r.day, r.route): r.views for r in relational.traffic_daily(events).collect()}


def test_progress_is_told(spark, tmp_path):
    import time

    from proselake.streaming import progress

    told = []
    listener = progress.watch(spark, lambda *x: told.append(x))
    src = str(tmp_path / "src")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(src)
    q = S.traffic_stream(S.read_events(spark, src)).writeStream.format("memory").queryName("told").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(100)
    for _ in range(50):
        if any(x == ("told", None, None) for x in told):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert any(n == "told" and rows for n, _, rows in told) and ("told", None, None) in told
    steps = []
    out = progress.staged(spark.range(5), [("a", lambda d: d.where("id > 1")), ("b", lambda d: d.where("id > 2"))], lambda *x: steps.append(x))
    assert out.count() == 2 and steps == [("a", 1, 2), ("b", 2, 2)]


def test_fifo_meets_what_is_required(spark):
    grants = spark.createDataFrame([("a", 1, 5, None), ("a", 2, 7, 10), ("a", 3, 9, 5), ("b", 4, 1, None)], "account string, id int, remaining long, expires long")
    need = spark.createDataFrame([("a", 12), ("b", 5)], "account string, required long")
    got = relational.fifo_allocation(grants, need, "account", [F.col("expires").asc_nulls_last(), F.col("id")]).collect()
    assert {r.id: r["take"] for r in got} == {3: 9, 2: 3, 1: 0, 4: 1}


def test_units_of_many_texts_like_one_by_one(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aZ9é '’’''\u0301\u200b\ufe0f中〇，.\n\U0001f600\u212bßя-_\x00") for _ in range(rng.randrange(12))) for _ in range(4000)] + ["", "'", "a'", "'a", "a", "\u0301"]
    got = E.units_of(texts).T.tolist()
    assert got == [list(E.billable_units(t).values()) for t in texts] and E.units_of([]).shape == (4, 0)
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, text string")
    rows = {r.id: r.u for r in df.select("id", E.billable_units_udf("text").alias("u")).collect()}
    assert rows[-1].total == 0 and [rows[i].total for i in range(len(texts))] == [g[3] for g in got]


def test_diff_runs_hold_few_texts_at_once():
    import pyarrow as pa

    before, after = ["", None, "a b", *(f"one {i} two" for i in range(200))], ["", "x", None, *(f"one {i} three" for i in range(200))]
    got = E.diff_runs_udf.func(pa.array(before), pa.array(after)).to_pylist()
    assert got == [[{"kind": k, "text": t} for k, t in E.diff_runs(a or "", b or "")] for a, b in zip(before, after, strict=True)]
    assert len(E.diff_runs_udf.func(pa.array([], pa.string()), pa.array([], pa.string()))) == 0
