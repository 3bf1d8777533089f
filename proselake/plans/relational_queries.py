"""Relational queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import table

DAY = "CAST(timezone('Asia/Shanghai', timezone('UTC', ts)) AS DATE)"
MICROS = "epoch_us(ts)"
CENTS = "CAST(round({} * 100) AS BIGINT)"


def traffic_daily(spark, d):
    return R.traffic_daily(table(spark, d, "events"))


def traffic_gapfill(spark, d):
    return R.gap_filled(R.traffic_daily(table(spark, d, "events")), "2024-02-10", 30)


def traffic_top_routes(spark, d):
    return R.top_routes(R.traffic_daily(table(spark, d, "events")), 3)


def traffic_allowed(spark, d):
    return R.traffic_daily(table(spark, d, "events"), ["click", "view"])


def rate_window(spark, d):
    return R.rate_window(table(spark, d, "events"), 86_400, 3)


def failure_window(spark, d):
    e = table(spark, d, "events")
    return R.rate_window(e.where(F.col("event_type") == "click"), 7 * 86_400, 10)


def cooldown(spark, d):
    return R.cooldown(table(spark, d, "events"), 3600)


def event_dedup(spark, d):
    e = table(spark, d, "events").withColumn("key", F.col("event_id") % 997)
    return R.fold_idempotent(e, "key", ["event_type"], ["event_id"])


def latest_event(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return R.latest(e, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def event_revisions(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return R.revisions(e, "user_id", "event_id", "event_type")


def customer_search_page(spark, d):
    return R.search_page(table(spark, d, "customer"), table(spark, d, "nation"), "1", 50, 20)


def account_overview(spark, d):
    return R.account_overview(table(spark, d, "customer"), table(spark, d, "orders"))


def sales_by_currency(spark, d):
    return R.sales_by(table(spark, d, "orders"), "o_orderpriority", ["F", "O"])


def jobs_by_state(spark, d):
    return R.state_counts(table(spark, d, "orders"), "o_orderstatus")


def stale_anti(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    li = table(spark, d, "lineitem").where(F.col("l_quantity") > 25).select(F.col("l_orderkey").alias("k"))
    return R.without_any(o, "k", [li])


def refund_semi(spark, d):
    o = table(spark, d, "orders")
    ref = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.concat(F.lit("order:"), F.col("l_orderkey")).alias("ref")).distinct()
    return o.select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("ref"), "o_custkey").join(ref, "ref", "left_semi")


def _grants(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("account"), F.col("l_linenumber").alias("id"), "l_partkey", "l_suppkey", "l_shipdate", F.col("l_quantity").cast("long").alias("remaining"))


GRANT_ORDER = ["l_shipdate", "id", "l_partkey", "l_suppkey", "remaining"]


def fifo_allocation(spark, d):
    need = table(spark, d, "orders").select(F.col("o_orderkey").alias("account"), (F.floor(F.col("o_totalprice")) % 120).cast("long").alias("required"))
    return R.fifo_allocation(_grants(spark, d), need, "account", [F.col(c) for c in GRANT_ORDER]).select("account", "id", "l_partkey", "l_suppkey", "remaining", "take")


def running_balance(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", R.cents(F.col("value")).alias("delta"))
    return R.running_balance(e, "user_id", ["event_id"], "delta")


def grant_recalc(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("grant_id"), F.lit(200).cast("long").alias("granted"), (F.col("o_orderkey") % 50).alias("refunded"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grant_id"), F.col("l_quantity").cast("long").alias("amount"), F.col("l_linestatus").alias("status"))
    return R.grant_recalc(o, li, ["O"])


def reserved_ceiling(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("units"))
    return li.withColumn("reserved", R.reserved_credits(F.col("units"), F.lit(1250)))


def refund_prorata(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("credits"), R.cents(F.col("l_extendedprice")).alias("amount"))
    li = li.withColumn("refunded", F.expr("amount div 3"))
    return li.withColumn("credits_back", R.prorated("credits", "refunded", "amount"))


def reconciliation(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), R.cents(F.col("o_totalprice")).alias("amount"), F.lit(0).cast("long").alias("booked"))
    li = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("amount"), F.col("l_linestatus").alias("currency"))
    return R.net_of_refunds(o, li, "k")


def plan_argmax(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return R.arg_max(li, "l_suppkey", F.col("l_partkey"), [F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], "best")


def top_k_per_group(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return R.top_k(li, "l_suppkey", [F.desc("q"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3)


def paged_grants(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.top_k(o, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rank")


SQL = {
    "traffic_daily": f"SELECT {DAY} AS day, event_type AS route, count(*) AS views FROM events GROUP BY 1, 2",
    "traffic_gapfill": f"""WITH s AS (SELECT CAST(unnest(generate_series(DATE '2024-01-12', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS day),
        t AS (SELECT {DAY} AS day, count(*) AS views FROM events GROUP BY 1) SELECT s.day, coalesce(t.views, 0) AS views FROM s LEFT JOIN t ON s.day = t.day""",
    "traffic_top_routes": "SELECT event_type AS route, count(*) AS views FROM events GROUP BY 1 ORDER BY views DESC, route LIMIT 3",
    "traffic_allowed": f"SELECT {DAY} AS day, event_type AS route, count(*) AS views FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2",
    "rate_window": f"""WITH c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY {MICROS} RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events)
        SELECT event_id, user_id, n, n > 3 AS limited FROM c""",
    "failure_window": f"""WITH c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY {MICROS} RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS n
        FROM events WHERE event_type = 'click') SELECT event_id, user_id, n, n > 10 AS limited FROM c""",
    "cooldown": f"""WITH c AS (SELECT event_id, user_id, ({MICROS} - lag({MICROS}) OVER (PARTITION BY user_id ORDER BY {MICROS}, event_id)) // 1000000 AS gap FROM events)
        SELECT event_id, user_id, gap, coalesce(gap < 3600, false) AS blocked FROM c""",
    "event_dedup": """WITH e AS (SELECT event_id % 997 AS key, event_id, event_type FROM events), f AS (SELECT key, min_by(event_type, event_id) AS first FROM e GROUP BY key)
        SELECT key, CAST(count(*) FILTER (event_type = first) - 1 AS BIGINT) AS duplicates, CAST(count(*) FILTER (event_type <> first) AS BIGINT) AS conflicts FROM e JOIN f USING (key) GROUP BY key""",
    "latest_event": """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "event_revisions": """WITH c AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS last, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS revision FROM c WHERE n = 1 OR event_type IS DISTINCT FROM last""",
    "customer_search_page": """SELECT c_custkey, c_name, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1') OR contains(lower(n_name), '1') ORDER BY c_custkey LIMIT 50 OFFSET 20""",
    "account_overview": f"""SELECT c_custkey, count(o_orderkey) AS n_orders, count(*) FILTER (o_orderstatus = 'O') AS n_open,
        CAST(coalesce(sum({CENTS.format('o_totalprice')}), 0) AS BIGINT) AS cents FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "sales_by_currency": f"""SELECT o_orderpriority AS currency, count(*) AS n_orders, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS cents FROM orders
        WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""",
    "jobs_by_state": "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1",
    "stale_anti": "SELECT o_orderkey AS k, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)",
    "refund_semi": "SELECT 'order:' || o_orderkey AS ref, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "fifo_allocation": """WITH g AS (SELECT l_orderkey AS account, l_linenumber AS id, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS remaining, l_shipdate FROM lineitem),
        b AS (SELECT *, coalesce(sum(remaining) OVER (PARTITION BY account ORDER BY l_shipdate, id, l_partkey, l_suppkey, remaining ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
        SELECT account, id, l_partkey, l_suppkey, remaining, CAST(greatest(0, least(remaining, CAST(floor(o_totalprice) AS BIGINT) % 120 - before)) AS BIGINT) AS take
        FROM b JOIN orders ON account = o_orderkey""",
    "running_balance": f"""SELECT user_id, event_id, {CENTS.format('value')} AS delta, CAST(sum({CENTS.format('value')}) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS balance FROM events""",
    "grant_recalc": """SELECT o_orderkey AS grant_id, CAST(greatest(0, 200 - o_orderkey % 50 - coalesce(used, 0)) AS BIGINT) AS remaining FROM orders
        LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS used FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON l_orderkey = o_orderkey""",
    "reserved_ceiling": """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS units, (CAST(l_quantity AS BIGINT) * 1250 + 999) // 1000 AS reserved FROM lineitem""",
    "refund_prorata": f"""WITH x AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS credits, {CENTS.format('l_extendedprice')} AS amount FROM lineitem)
        SELECT *, amount // 3 AS refunded, CASE WHEN amount = 0 THEN 0 ELSE (credits * (amount // 3)) // amount END AS credits_back FROM x""",
    "reconciliation": f"""WITH r AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS refunded, count(DISTINCT l_linestatus) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT o_orderkey AS k, {CENTS.format('o_totalprice')} AS amount, coalesce(refunded, 0) AS refunded, coalesce(refunded, 0) <> 0 OR coalesce(n, 1) <> 1 AS reconciliation_required
        FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""",
    "plan_argmax": """SELECT l_suppkey, l_partkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS n FROM lineitem) WHERE n = 1""",
    "top_k_per_group": """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, q, CAST(n AS INT) AS rank FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS BIGINT) DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 3""",
    "paged_grants": """SELECT o_custkey, o_orderkey, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5""",
}

QUERIES = {name: globals()[name] for name in SQL}
