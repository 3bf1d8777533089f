"""Order state: stream and batch agree, whatever the order of arrival."""

import random
import time

import pytest
from pyspark.sql import functions as F

from proselake.streaming import orders as O
from proselake.streaming import state as S

E = [
    ("e1", "p1", None, "refund", "succeeded", 30, None, "r1", 5), ("e2", "p1", "o1", "payment", "paid", 100, 50, None, 1), ("e2", "p1", "o1", "payment", "paid", 100, 50, None, 1),
    ("e2", "p1", "o1", "payment", "paid", 999, 50, None, 9), ("u1", "p1", None, "use", "committed", 40, None, "j1", 3), ("u2", "p1", None, "use", "released", 9, None, "j2", 4),
    ("e3", "p2", "o2", "payment", "expired", 0, 0, None, 1), ("e4", "p2", "o2", "payment", "paid", 50, 20, None, 2), ("e5", "p2", None, "refund", "succeeded", 50, None, "r2", 3), ("e6", "p2", None, "refund", "failed", 50, None, "r2", 8),
    ("e7", "p3", "o3", "payment", "failed", 0, 0, None, 1), ("e8", "p4", "o4", "payment", "paid", 20, 10, None, 1), ("e9", "p4", None, "refund", "succeeded", 20, None, "r3", 2),
    ("e10", "p5", None, "refund", "succeeded", 7, None, "r4", 1), ("e11", "p6", "o6", "payment", "paid", 10, 10, None, 1), ("e12", "p6", None, "refund", "succeeded", 11, None, "r5", 2),
    ("e13", "p7", None, "use", "reserved", 3, None, "j3", 1), ("e14", "p8", "o8", "payment", "paid", 90, 31, None, 5), ("e14", "p8", "o8", "payment", "expired", 0, 0, None, 2), (None, "p9", "o9", "payment", "paid", 1, 1, None, 1), ("e15", None, "o9", "payment", "paid", 1, 1, None, 1),
]


def frame(spark, rows):
    raw = spark.createDataFrame([r[:8] + (None,) + (r[8],) for r in rows], O.EVENTS + ", s long")
    return raw.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_batch_values(spark):
    got = {r.payment: r.asDict() for r in O.settled(frame(spark, E)).collect()}
    view = {k: (v["status"], v["amount"], v["refunded"], v["refunded_credits"], v["used"], v["remaining"], v["waiting"], v["duplicates"], v["conflicts"]) for k, v in got.items()}
    assert view == {
        "p1": ("partially_refunded", 100, 30, 15, 40, 0, 0, 1, 1),
        "p2": ("paid", 50, 0, 0, 0, 20, 0, 0, 0),  # the refund failed later: what is not used comes back
        "p3": ("failed", 0, 0, 0, 0, 0, 0, 0, 0),
        "p4": ("refunded", 20, 20, 10, 0, 0, 0, 0, 0),
        "p5": ("pending_order", 0, 0, 0, 0, 0, 7, 0, 0),
        "p6": ("mismatch", 10, 11, 10, 0, 0, 0, 0, 0),
        "p7": ("pending", 0, 0, 0, 3, 0, 0, 0, 0),
        "p8": ("expired", 0, 0, 0, 0, 0, 0, 0, 1),
    }
    assert O.settled(frame(spark, E[:0])).count() == 0


def test_batch_shuffles_events_once(spark):
    plan = O.settled(frame(spark, E))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_stream_equals_batch_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = E + [
        (f"x{rng.randrange(60)}", f"p{rng.randrange(10, 22)}", rng.choice(["a", "b"]), kind, rng.choice(states), rng.randrange(1, 30), rng.randrange(9), rng.choice(["s", "t"]), rng.randrange(20))
        for kind, states in [("payment", ["paid", "expired", "failed"]), ("refund", ["succeeded", "failed", "pending"]), ("use", ["reserved", "committed", "released"])] * 40
    ]
    want = {r.payment: r.asDict() for r in O.settled(frame(spark, rows)).collect()}
    rng.shuffle(rows)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for i in range(0, len(rows), 80):
        frame(spark, rows[i : i + 80]).coalesce(1).write.mode("append").parquet(src)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    O.use_typed_state(spark)
    try:
        stream = O.settled_stream(S.read_events(spark, src, O.EVENTS), remember=60_000)
        q = stream.writeStream.foreachBatch(S.upsert(spark, out, ["payment"])).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
        done, until = 0, time.time() + 240
        while done < len(rows) and q.isActive and time.time() < until:  # timers keep such a stream going, so it is stopped here
            time.sleep(0.5)
            done = sum(p.numInputRows for p in q.recentProgress)
        q.stop()
        assert done == len(rows)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = sorted((tmp_path / "out").glob("v=*"), key=lambda p: int(p.name[2:]))[-1]
    got = {r.payment: r.asDict() for r in spark.read.parquet(str(last)).collect()}
    assert got == want


def test_expired_ids_keep_what_they_said(spark, tmp_path):
    """With ids dropped after a millisecond all but the counts of repetitions stays as it is."""
    rows = [r for r in E if r[0] and r[1] and r[:9] != E[3] and r[1] != "p8"]
    want = {r.payment: r.asDict() for r in O.settled(frame(spark, rows)).drop("duplicates").collect()}
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part in (rows[::2], rows[1::2], rows):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    O.use_typed_state(spark)
    try:
        q = O.settled_stream(S.read_events(spark, src, O.EVENTS), remember=1).writeStream.foreachBatch(S.upsert(spark, out, ["payment"])).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
        done, until = 0, time.time() + 200
        while done < 2 * len(rows) and q.isActive and time.time() < until:
            time.sleep(0.5)
            done = sum(p.numInputRows for p in q.recentProgress)
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = sorted((tmp_path / "out").glob("v=*"), key=lambda p: int(p.name[2:]))[-1]
    assert {r.payment: r.asDict() for r in spark.read.parquet(str(last)).drop("duplicates").collect()} == want
