"""Queries of payments, refunds and entitlements over real orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import paged as G
from ..sources.tables import table
from ..streaming import orders as O


def payment_events(spark, d):
    """What orders and their lines say as events: a payment for each order, a refund for each returned line, a use for each other one."""
    o = table(spark, d, "orders").withColumn("cents", F.floor(F.col("o_totalprice") * 100).cast("long")).withColumn("at", F.col("o_orderdate").cast("timestamp"))
    key = F.col("o_orderkey").cast("string")
    status = F.when(F.col("o_orderstatus") == "P", "expired").otherwise("paid")
    pay = lambda df, cents, at: df.select(F.concat(F.lit("p"), key).alias("event_id"), F.concat(F.lit("pi_"), key).alias("payment"), key.alias("order_id"), F.lit("payment").alias("kind"), status.alias("status"), cents.alias("amount"), F.expr("cents div 1000").alias("credits"), F.lit(None).cast("string").alias("ref"), at.alias("ts"))
    cents, at = F.col("cents"), F.col("at")
    pays = pay(o, cents, at).unionByName(pay(o.where("o_orderkey % 7 = 0"), cents, at)).unionByName(pay(o.where("o_orderkey % 11 = 0"), cents + 1, at + F.expr("INTERVAL 1 DAY")))
    li = table(spark, d, "lineitem").withColumn("name", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date")))
    back, late = F.col("l_returnflag") == "R", F.expr("CAST(l_shipdate AS TIMESTAMP)")
    line = lambda df, prefix, state, at: df.select(
        F.concat(F.lit(prefix), "name").alias("event_id"), F.concat(F.lit("pi_"), F.col("l_orderkey").cast("string")).alias("payment"), F.lit(None).cast("string").alias("order_id"), F.when(back, "refund").otherwise("use").alias("kind"), state.alias("status"),
        F.when(back, F.floor(F.col("l_extendedprice") * 100).cast("long")).otherwise(F.col("l_quantity").cast("long")).alias("amount"), F.lit(None).cast("long").alias("credits"), F.col("name").alias("ref"), at.alias("ts"),
    )
    state = F.when(back, "succeeded").when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", "committed").otherwise("reserved")).otherwise("released")
    failed = line(li.where(back & (F.col("l_linenumber") == 2)), "f", F.lit("failed"), late + F.expr("INTERVAL 30 DAYS"))
    return pays.unionByName(line(li, "l", state, late)).unionByName(failed)


def order_entitlements(spark, d):
    return O.settled(payment_events(spark, d))


SECRET = "of these queries only"
_INNER, _OUTER = (bytes(b ^ x for b in SECRET.encode().ljust(64, b"\0")) for x in (0x36, 0x5C))


def signed_events(spark, d):
    """Events as signed bodies, of which some were changed, some have no header and some are old."""
    body = F.concat_ws("|", "event_id", "event_type", "props")
    at = F.unix_timestamp("ts").cast("string")
    inner = F.unhex(F.sha2(F.concat(F.lit(_INNER), F.encode(F.concat_ws(".", at, body), "utf-8")), 256))
    header = F.concat(F.lit("t="), at, F.lit(",v1="), F.sha2(F.concat(F.lit(_OUTER), inner), 256))
    sent = F.when(F.col("event_id") % 5 == 1, F.concat(body, F.lit(" "))).otherwise(body)
    now = F.unix_timestamp("ts") + F.when(F.col("event_id") % 7 == 2, 301).otherwise(300)
    e = table(spark, d, "events").select("event_id", sent.alias("body"), F.when(F.col("event_id") % 11 != 3, header).alias("header"), now.alias("now"))
    return e.select("event_id", G.signature(F.col("body"), F.col("header"), F.col("now"), ["former", SECRET]).alias("state"))


SQL = {
    "signed_events": f"""WITH e AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t, concat_ws('|', event_id, event_type, props) AS body FROM events),
        h AS (SELECT event_id, t, body, sha256(from_hex('{_OUTER.hex()}') || from_hex(sha256(from_hex('{_INNER.hex()}') || encode(t || '.' || body)))) AS sent FROM e),
        g AS (SELECT *, sha256(from_hex('{_OUTER.hex()}') || from_hex(sha256(from_hex('{_INNER.hex()}') || encode(t || '.' || CASE WHEN event_id % 5 = 1 THEN body || ' ' ELSE body END)))) AS got FROM h)
        SELECT event_id, CASE WHEN event_id % 11 = 3 THEN 'missing' WHEN sent <> got THEN 'invalid' WHEN event_id % 7 = 2 THEN 'stale' ELSE 'valid' END AS state FROM g""",
    "order_entitlements": """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderkey AS n, CASE WHEN o_orderstatus = 'P' THEN 'expired' ELSE 'paid' END AS s, CAST(floor(o_totalprice * 100) AS BIGINT) AS c FROM orders),
        l AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, l_returnflag AS f, l_linenumber AS i, CAST(floor(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
        g AS (SELECT k, coalesce(sum(c) FILTER (f = 'R' AND i <> 2), 0) AS back, coalesce(sum(q) FILTER (f = 'A'), 0) AS used, count(*) FILTER (f = 'R') AS refunds FROM l GROUP BY k),
        j AS (SELECT coalesce(o.k, g.k) AS k, o.n, o.s, o.c, o.c // 1000 AS credits, coalesce(back, 0) AS back, coalesce(used, 0) AS used, coalesce(refunds, 0) AS refunds FROM o FULL JOIN g ON g.k = o.k),
        v AS (SELECT *, coalesce(s = 'paid', false) AS paid, CASE WHEN back >= c THEN credits ELSE credits * back // c END AS gone FROM j)
        SELECT 'pi_' || k AS payment, CASE WHEN n IS NOT NULL THEN k END AS order_id,
            CASE WHEN NOT paid THEN CASE WHEN s IS NOT NULL THEN s WHEN refunds > 0 THEN 'pending_order' ELSE 'pending' END WHEN back > c THEN 'mismatch' WHEN back = c THEN 'refunded' WHEN back > 0 THEN 'partially_refunded' ELSE 'paid' END AS status,
            CASE WHEN paid THEN c ELSE 0 END AS amount, CAST(CASE WHEN paid THEN back ELSE 0 END AS BIGINT) AS refunded, CASE WHEN paid THEN credits ELSE 0 END AS credits, CAST(CASE WHEN paid THEN gone ELSE 0 END AS BIGINT) AS refunded_credits,
            CAST(used AS BIGINT) AS used, CAST(CASE WHEN paid THEN greatest(0, credits - gone - used) ELSE 0 END AS BIGINT) AS remaining, CAST(CASE WHEN paid THEN 0 ELSE back END AS BIGINT) AS waiting,
            CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS duplicates, CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS conflicts FROM v""",
}
QUERIES = {name: globals()[name] for name in SQL}
