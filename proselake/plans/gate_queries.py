"""Queries of gates, quotes, reservations and queues over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import prose as P
from ..operators import relational as R
from ..sources.tables import table


def _q(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"), "l_returnflag", "l_linestatus")


def job_gate(spark, d):
    why = G.job_gate(F.col("l_returnflag") != "R", F.col("q") - 2, F.lit(40), F.col("q") * 3, F.lit(90))
    return _q(spark, d).withColumn("reject", why)


def refund_gate(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", R.cents(F.col("o_totalprice")).alias("cents"))
    status = F.when(F.col("o_orderstatus") == "F", "paid").otherwise("pending")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", G.refund_gate(k % 11 != 0, status, F.col("cents") % 1000 - 10, F.lit(800), k % 5, k % 3, F.lit(0)).alias("reject"))


def pending_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("paid").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") * 10).alias("expires_at"), (F.col("o_orderkey") * 7).alias("created_at"))
    return G.pending_orders(o, 20_000)


def price_quotes(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("product"))
    prices = _q(spark, d).groupBy(F.col("l_partkey").alias("product"), F.col("l_returnflag").alias("currency")).agg(F.max("q").alias("amount"))
    return G.quotes(part, prices, "R")


def metering_versions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 4 WHEN 0 THEN '{\"metering_version\": 2}' WHEN 1 THEN '{}' WHEN 2 THEN 'no json' END").alias("j"))
    return o.select("o_orderkey", G.metering_version(F.col("j")).alias("version"))


def rejected_rows(spark, d):
    return G.rejects(_q(spark, d), {"small": F.col("q") >= 3, "flag": F.col("l_returnflag").isin("A", "N", "R"), "line": F.col("l_linenumber") <= 6})


def ledger_totals(spark, d):
    e = table(spark, d, "events").select("user_id", (R.cents(F.col("value")) - 5000).alias("delta"))
    return G.ledger_totals(e, "user_id", "delta")


def settlement(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("job_id"), F.col("event_id").alias("seq"), "user_id", R.cents(F.col("value")).alias("amount"))
    first = F.min("seq").over(Window.partitionBy("job_id")) == F.col("seq")
    kind = F.when(first | (F.col("user_id") % 3 == 2), "reserve").when(F.col("user_id") % 3 == 0, "release").otherwise("commit")
    return G.settle(e.withColumn("kind", kind))


def queue_depth(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("queued_at"), "user_id")
    return G.queue_depth(e.select("job_id", "queued_at", F.expr("CASE WHEN user_id % 10 > 0 THEN queued_at + user_id * 60 END").alias("started_at")))


def challenges(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("challenge_id"), F.col("event_id").alias("attempt_id"), F.col("event_id").alias("at"), (F.col("user_id") * 2).alias("created_at"), (F.col("event_type") == "click").alias("right"))
    return G.challenge(e, 5, 2000)


def deletion_blockers(spark, d):
    acc = table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("account_id"), "o_orderstatus", "o_orderpriority")
    jobs, orders = o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderstatus = 'O'")
    paid = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("account_id"))
    return G.deletion_blockers(acc, jobs, orders, paid).select("account_id", F.concat_ws(",", "blockers").alias("blockers"))


def paragraph_pairs(spark, d):
    p = P.paragraph_segments(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "para", "text")
    other = p.where("doc_id > 0").select((F.col("doc_id") - 1).alias("doc_id"), "para", "text")
    return G.paragraph_pairs(p, other)


def multiset_difference(spark, d):
    e = table(spark, d, "events")
    side = lambda p: e.where(p).select("event_type", (F.col("user_id") % 10).alias("u"))
    return G.multiset_difference(side("event_id % 2 = 0"), side("event_id % 2 = 1"))


def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", G.fingerprint(F.lit("strong"), F.col("source")).alias("sha"))


def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", G.token_estimate(F.col("text")).alias("tokens"))


CENTS = "CAST(round({} * 100) AS BIGINT)"
QCTE = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, l_returnflag, l_linestatus FROM lineitem"
PARA = """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS para, t AS text FROM (
    SELECT doc_id, i, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE len(t) > 0"""
SQL = {
    "job_gate": f"SELECT *, CASE WHEN l_returnflag = 'R' THEN 'strength' WHEN q - 2 > 40 THEN 'size' WHEN q - 2 <= 0 THEN 'empty' WHEN q * 3 > 90 THEN 'balance' END AS reject FROM ({QCTE})",
    "refund_gate": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'mode' WHEN o_orderstatus <> 'F' THEN 'status' WHEN c % 1000 - 10 <= 0 OR c % 1000 - 10 > 800 THEN 'amount'
        WHEN o_orderkey % 5 > 0 THEN 'open_attempt' WHEN o_orderkey % 3 <> 0 THEN 'reconcile' END AS reject FROM (SELECT *, {CENTS.format('o_totalprice')} AS c FROM orders)""",
    "pending_orders": """SELECT o_orderkey, 'pending' AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 10 END AS expires_at, o_orderkey * 7 AS created_at FROM orders
        WHERE o_orderstatus = 'O' AND ((o_orderkey % 2 = 0 AND o_orderkey * 10 > 20000) OR (o_orderkey % 2 <> 0 AND o_orderkey * 7 > 18200))""",
    "price_quotes": f"SELECT p_partkey AS product, 'R' AS currency, amount FROM part LEFT JOIN (SELECT l_partkey, max(q) AS amount FROM ({QCTE}) WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey",
    "metering_versions": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 2 ELSE 1 END AS version FROM orders",
    "rejected_rows": f"SELECT *, CASE WHEN q < 3 THEN 'small' WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 'flag' ELSE 'line' END AS reject FROM ({QCTE}) WHERE q < 3 OR l_returnflag NOT IN ('A', 'N', 'R') OR l_linenumber > 6",
    "ledger_totals": f"""SELECT user_id, CAST(sum(greatest(d, 0)) AS BIGINT) AS increases, CAST(sum(abs(least(d, 0))) AS BIGINT) AS decreases FROM (SELECT user_id, {CENTS.format('value')} - 5000 AS d FROM events) GROUP BY user_id""",
    "settlement": f"""WITH e AS (SELECT event_id // 3 AS job_id, event_id AS seq, CASE WHEN event_id = min(event_id) OVER (PARTITION BY event_id // 3) OR user_id % 3 = 2 THEN 'reserve' WHEN user_id % 3 = 0 THEN 'release' ELSE 'commit' END AS kind,
            {CENTS.format('value')} AS amount FROM events),
        p AS (SELECT job_id, min_by(amount, seq) FILTER (kind = 'reserve') AS reserved, min_by(kind, seq) FILTER (kind <> 'reserve') AS closed, min_by(amount, seq) FILTER (kind = 'commit') AS used FROM e GROUP BY job_id),
        c AS (SELECT *, CASE WHEN closed = 'commit' THEN least(reserved, coalesce(used, reserved)) ELSE 0 END AS charged FROM p WHERE reserved IS NOT NULL)
        SELECT job_id, reserved, coalesce(closed, 'open') AS state, charged, CASE WHEN closed IS NULL THEN 0 ELSE reserved - charged END AS returned FROM c""",
    "queue_depth": """WITH j AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS q, user_id FROM events), b AS (SELECT event_id AS job_id, q AS t, 1 AS step FROM j UNION ALL SELECT NULL, q + user_id * 60, -1 FROM j WHERE user_id % 10 > 0)
        SELECT job_id, depth FROM (SELECT job_id, CAST(sum(step) OVER (ORDER BY t, step, coalesce(job_id, -1) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS depth FROM b) WHERE job_id IS NOT NULL""",
    "challenges": """WITH a AS (SELECT user_id AS challenge_id, event_id AS t, user_id * 2 AS c, event_type = 'click' AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
        SELECT challenge_id, count(*) AS attempts, CAST(min(n) FILTER (n <= 5 AND t - c <= 2000 AND r) AS INT) AS passed_at, min(n) FILTER (n <= 5 AND t - c <= 2000 AND r) IS NOT NULL AS passed FROM a GROUP BY challenge_id""",
    "deletion_blockers": """SELECT c_custkey AS account_id, concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 'jobs' END,
        CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') THEN 'orders' END, CASE WHEN c_acctbal > 5000 THEN 'balance' END) AS blockers FROM customer""",
    "paragraph_pairs": f"""WITH p AS ({PARA}), o AS (SELECT doc_id - 1 AS doc_id, para, text FROM p WHERE doc_id > 0)
        SELECT doc_id, para, p.text AS before, o.text AS after, p.text IS NOT DISTINCT FROM o.text AS same FROM p FULL JOIN o USING (doc_id, para)""",
    "multiset_difference": """SELECT event_type, u, count(*) AS n FROM (SELECT event_type, user_id % 10 AS u FROM events WHERE event_id % 2 = 0 EXCEPT ALL SELECT event_type, user_id % 10 FROM events WHERE event_id % 2 = 1) GROUP BY 1, 2""",
    "fingerprints": "SELECT doc_id, sha256('strong' || chr(0) || source) AS sha FROM documents",
    "token_estimates": """SELECT doc_id, CAST(h + (len(text) - h) // 4 AS BIGINT) AS tokens FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS h FROM documents)""",
}
QUERIES = {name: globals()[name] for name in SQL}
