"""Paged lists read in parallel, a feed that resumes, and signatures."""

import json

import pytest
from pyspark.sql import functions as F

from proselake.sources import paged as G


def folders(tmp_path, sizes):
    for part, n in sizes.items():
        (tmp_path / part).mkdir(parents=True)
        (tmp_path / part / "items.jsonl").write_text("".join(json.dumps({"id": f"{part}-{i:04d}", "amount": i}) + "\n" for i in range(n)))
    return str(tmp_path)


def test_pages_are_read_in_parallel_and_once(spark, tmp_path):
    sizes = {"pi_a": 250, "pi_b": 0, "pi_c": 100, "pi_d": 101, "pi_e": 1}
    root = folders(tmp_path / "lists", sizes)
    G.register_pages(spark, "lists", lambda: G.FolderPager(root))
    df = spark.read.format("lists").load()
    assert df.rdd.getNumPartitions() == len(sizes)
    rows = df.collect()
    assert len(rows) == len({r.item_id for r in rows}) == sum(sizes.values())
    pages = {(r.part, r.page) for r in rows}
    assert pages == {("pi_a", 0), ("pi_a", 1), ("pi_a", 2), ("pi_c", 0), ("pi_d", 0), ("pi_d", 1), ("pi_e", 0)}
    assert df.select(F.sum(F.get_json_object("body", "$.amount").cast("long"))).first()[0] == sum(n * (n - 1) // 2 for n in sizes.values())
    (tmp_path / "none").mkdir()
    none = str(tmp_path / "none")
    G.register_pages(spark, "no_lists", lambda: G.FolderPager(none))
    assert spark.read.format("no_lists").load().count() == 0


class Odd:
    def __init__(self, kind):
        self.kind = kind

    def parts(self):
        return ["x"]

    def page(self, part, after, limit):
        if self.kind == "empty":
            return [], True
        return [{"id": "same" if self.kind == "stuck" else f"{after}x"}], True


@pytest.mark.parametrize("kind, says", [("empty", "is empty"), ("stuck", "earlier one"), ("endless", "more than 7 pages")])
def test_odd_lists_end_in_errors(kind, says):
    with pytest.raises(ValueError, match=says):
        list(G.pages(Odd(kind), "x", most=7))


def test_feed_resumes_where_it_stopped(spark, tmp_path):
    feed, out, ck = (str(tmp_path / x) for x in ("feed", "out", "ck"))
    (tmp_path / "feed").mkdir()

    def put(n):
        start = len(list((tmp_path / "feed").iterdir()))
        for i in range(start, start + n):
            body = json.dumps({"id": i})
            header = {0: None, 1: G.sign(body, "other", 1000), 2: G.sign(body + " ", "key", 1000), 3: G.sign(body, "key", 100)}.get(i % 7, G.sign(body, "key", 1000))
            (tmp_path / "feed" / f"{i:010d}.json").write_text(json.dumps({"body": body, "signature": header}))

    G.register_feed(spark, "feed", lambda: G.FolderFeed(feed), records=10)
    total = 0
    for n in (25, 0, 13):
        put(n)
        total += n
        stream = spark.readStream.format("feed").load().withColumn("state", G.signature(F.col("body"), F.col("signature"), F.lit(1200), ["old", "key"]))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
        q.processAllAvailable()
        q.stop()
    rows = sorted(spark.read.parquet(out).collect())
    assert [r.position for r in rows] == list(range(total))
    want = {0: "missing", 1: "invalid", 2: "invalid", 3: "stale"}
    assert all(r.state == want.get(r.position % 7, "valid") for r in rows)


def test_headers():
    good = G.sign("é{}", "k", 50)
    assert G.check("é{}", good, ["k"], 50) == G.check("é{}", "v0=1, " + good + ",v1=ff", ["j", "k"], 350) == "valid"
    assert [G.check(*x) for x in (("b", "", ["k"], 0), ("b", "t=1", ["k"], 0), ("b", "t=x,v1=a", ["k"], 0), (None, good, ["k"], 50), ("b", None, ["k"], 0), ("b", "t=1,t=2,v1=a", ["k"], 0))] == ["missing"] * 6
    assert G.check("é{}", good, ["k"], 351) == "stale" and G.check("é{} ", good, ["k"], 50) == "invalid"
