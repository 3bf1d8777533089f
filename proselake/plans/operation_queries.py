"""Queries of jobs, orders, refunds, sessions and account rows over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as X
from ..operators import operations as O
from ..operators import relational as R
from ..sources.tables import table
from ..streaming import state as S

CENTS = "CAST(round({} * 100) AS BIGINT)"
SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", R.cents(F.col("value")).alias("cents"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account_id"), "o_orderstatus", "o_orderpriority", "o_orderdate", R.cents(F.col("o_totalprice")).alias("amount"))


def owned_orders(spark, d):
    return O.owned(_orders(spark, d), "account_id", 7, [F.desc("o_orderdate"), F.desc("order_id")], 500).select("order_id", "account_id", "amount")


def oldest_queued(spark, d):
    jobs = _events(spark, d).select(F.col("event_id").alias("job_id"), "user_id", F.when(F.col("event_type") == "click", "queued").otherwise("done").alias("state"), F.col("at").alias("queued_at"))
    return O.oldest_queued(jobs, "user_id")


def soonest_expiry(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("account_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("expires_at"))
    return O.soonest_expiry(li, "account_id")


def pending_requests(spark, d):
    o = _orders(spark, d).select(F.col("order_id").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"))
    return O.pending_first(o, 50).select("id", "status")


def _runs(spark, d):
    e = table(spark, d, "events")
    variant = F.expr("CASE event_id % 5 WHEN 0 THEN '00_base' WHEN 1 THEN 'ZZ_ALL_' || event_id ELSE 'v' || event_id END")
    return e.select(F.col("user_id").alias("base"), variant.alias("variant"), F.expr("CASE event_id % 5 WHEN 2 THEN 'BURST' ELSE event_type END").alias("rule"), F.expr("CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN '12' END").alias("score"), F.col("event_type").alias("detector"), "event_id")


def manifest_order(spark, d):
    return O.manifest_order(_runs(spark, d)).select("event_id", "priority", "base", "variant")


def tier_progress(spark, d):
    return O.tier_progress(O.manifest_order(_runs(spark, d)))


def staff_grants(spark, d):
    acts = _events(spark, d).select(F.col("event_id").alias("act_id"), F.col("event_id").alias("grant_id"), (F.col("user_id") * 2).alias("actor_id"))
    grants = _orders(spark, d).select(F.col("order_id").alias("grant_id"), "account_id", F.col("amount").alias("remaining"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("email"))
    return O.granted_by_staff(acts, grants, people)


def _attempts(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("attempt_id"), F.col("l_partkey").alias("created_at"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'succeeded' WHEN 'A' THEN 'failed' ELSE 'created' END").alias("status"), F.col("l_quantity").cast("long").alias("amount"),
    )


def order_list(spark, d):
    people = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("email"))
    return O.order_list(_orders(spark, d), people, _attempts(spark, d))


def net_sales(spark, d):
    o = _orders(spark, d).select(
        (F.col("order_id") % 10 > 0).alias("live"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'partially_refunded' END").alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("currency"), "amount", (F.col("amount") % 100).alias("refunded"),
    )
    return O.net_sales(o)


def account_balances(spark, d):
    grants = _orders(spark, d).select("account_id", (F.col("amount") % 1000 - 100).alias("remaining"), F.when(F.col("o_orderstatus") == "F", 1).alias("revoked_at"), F.when(F.col("order_id") % 2 == 0, F.col("order_id")).alias("expires_at"))
    return O.balances(grants, table(spark, d, "customer").select(F.col("c_custkey").alias("account_id")), 500)


def committed_tokens(spark, d):
    e = _events(spark, d).select(F.when(F.col("event_type") == "purchase", "committed").otherwise("released").alias("status"), F.col("cents").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return O.committed_tokens(e)


def call_usage(spark, d):
    return O.call_usage(_events(spark, d).select((F.col("event_id") % 97).alias("job_id"), (F.col("event_type") != "click").alias("ok"), F.col("cents").alias("tokens")))


def all_variant_bound(spark, d):
    e = _events(spark, d).select(F.col("event_type").alias("detector"), F.when(F.col("user_id") % 4 == 0, "ALL").otherwise("S01").alias("rule"), (F.col("cents") % 100).cast("double").alias("delta"))
    return O.all_variant_bound(e)


def unresolved_disputes(spark, d):
    return O.unresolved(_events(spark, d).select("event_id", F.expr("CASE event_type WHEN 'click' THEN 'won' WHEN 'view' THEN 'warning_closed' ELSE 'needs_response' END").alias("status")))


def reconcile_run(spark, d):
    return O.reconcile(_orders(spark, d).select("order_id", (F.col("order_id") % 50 > 0).alias("ok"), (F.col("order_id") % 77 == 0).alias("disputed")))


def webhook_match(spark, d):
    o = _orders(spark, d).select("order_id", "account_id", F.when(F.col("order_id") % 9 > 0, F.col("amount")).alias("amount"))
    w = o.select("*", F.col("account_id").alias("w_account_id"), F.when(F.col("order_id") % 9 > 0, F.when(F.col("order_id") % 7 == 0, 1).otherwise(F.col("amount"))).alias("w_amount"))
    return w.select("order_id", O.matches_order(["account_id", "amount"]).alias("matches"))


def staff_rows(spark, d):
    o = _orders(spark, d).select("order_id", "account_id")
    return O.staff_only(o, "account_id", 7, [1, 2])


def stale_releases(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "view", "reserved").otherwise("committed").alias("status"), F.col("at").alias("created_at"), F.col("cents").alias("reserved"))
    live = _orders(spark, d).select(F.col("order_id").alias("job_id"))
    return O.stale_releases(e, live, 1_706_000_000)


def recover_jobs(spark, d):
    jobs = _orders(spark, d).select(F.col("order_id").alias("job_id"), F.expr("CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'queued' END").alias("state"))
    return O.recover(jobs, table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("job_id")))


def live_sessions(spark, d):
    return O.live_sessions(_sessions(spark, d), 1_706_000_000)


def _sessions(spark, d):
    return _events(spark, d).select(F.col("user_id").alias("account_id"), "event_id", (F.col("at") + F.col("event_id") % 1000 * 100).alias("expires_at"), F.when(F.col("event_type") == "click", F.col("at")).alias("revoked_at"))


def purgeable_sessions(spark, d):
    return O.purgeable(_sessions(spark, d), 1_706_000_000).select("event_id")


def checkouts(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("account_id"), (F.col("event_id") % 3).alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("product"), F.lit("CNY").alias("currency"), F.lit("mock").alias("provider"))
    return O.checkouts(e)


def refund_attempts(spark, d):
    return O.refund_attempts(_refund_events(spark, d))


def _refund_events(spark, d):
    status = F.expr("CASE event_type WHEN 'click' THEN 'submitted' WHEN 'view' THEN 'created' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END")
    return _events(spark, d).select(F.col("user_id").alias("order_id"), (F.col("event_id") % 40).alias("attempt_id"), F.col("event_id").alias("seq"), status.alias("status"))


def refund_locks(spark, d):
    return O.refund_locks(O.refund_attempts(_refund_events(spark, d)))


def backfill_versions(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, F.concat("lang", "text")).otherwise(F.col("text")).alias("source_text"))
    return O.backfill_versions(t, table(spark, d, "labels").select("doc_id")).select("doc_id", "revision", F.md5("text").alias("text"))


def retained_rows(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("account_id"))
    kept = O.retained_after_deletion({"jobs": _orders(spark, d), "ledger": _orders(spark, d).where("order_id % 2 = 0")}, gone, ["ledger"])
    return kept["jobs"].select("order_id", F.lit("jobs").alias("kind")).unionByName(kept["ledger"].select("order_id", F.lit("ledger").alias("kind")))


def newest_archive(spark, d):
    files = _events(spark, d).select(F.concat(F.lit("backup-"), "event_id").alias("path"), F.col("at").alias("modified"), F.col("cents").alias("length"))
    return O.newest_archive(files, 1_706_000_000, 86_400)


def receipts(spark, d):
    t = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.sha2(F.col("html"), 256).alias("sha256"), F.length("html").cast("long").alias("length"))
    want = t.select(F.when(F.col("path").endswith("3"), F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), F.when(F.col("path").endswith("5"), "0").otherwise(F.col("sha256")).alias("sha256"), "length")
    return O.verify_receipts(t, want)


def cursor_page(spark, d):
    return O.page_of(_orders(spark, d).select(F.col("order_id").alias("id"), "amount"), 100, 60)


def job_fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", O.job_key(F.col("source"), F.col("doc_id").cast("string")).alias("job"), O.canonical_digest(["lang", "doc_id"]).alias("digest"))


def job_progress(spark, d):
    o = _orders(spark, d)
    return o.select("order_id", O.progress(F.col("order_id") % 90, F.col("amount") % 80, F.lit(0).cast("long"), F.col("amount") - 1_000_000).alias("p")).select("order_id", "p.*")


def json_defaults(spark, d):
    return table(spark, d, "events").select("event_id", O.json_field(F.col("props"), "$.page", "string", "none").alias("page"), O.json_field(F.concat(F.lit("{"), F.col("event_type")), "$.a", "int", 3).alias("broken"))


ADDRESSES = ["A.b@Example.COM", " x+tag@mail.example.org ", "no-at.example.com", "a@@b.com", "a b@c.de", "a..b@c.de", "é@c.de", "x@-bad.com", "x@bad-.com", "x@nodot", "ok@a-b.co", "", ".x@c.de", "o'neil@c.ie"]
PATHS = ["/app", "/app/x?y=1#z", "//evil.example", "/a\\b", "https://x.example", "", "/ok/page-1.html#top", "/sp ace", "app", "/"]


def account_text(spark, d):
    rows = [(i, ADDRESSES[i % len(ADDRESSES)], PATHS[i % len(PATHS)], [None, " Ann ", "x" * 121, "a\tb", "李雷"][i % 5]) for i in range(70)]
    t = spark.createDataFrame(rows, "id long, address string, path string, name string")
    return t.select("id", O.email(F.col("address")).alias("email"), O.return_path(F.col("path")).alias("path"), O.display_name(F.col("name")).alias("name"))


def money_text(spark, d):
    e = _events(spark, d)
    return e.select("event_id", O.money(F.col("cents") * 1000 - 50_000, F.expr("CASE event_type WHEN 'click' THEN 'cny' WHEN 'view' THEN 'USD' WHEN 'purchase' THEN 'EUR' END")).alias("text"))


def guarded_saves(spark, d):
    return O.guarded_saves(_events(spark, d).select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("expected"), F.col("event_type").alias("text")))


def order_states(spark, d):
    e = table(spark, d, "events").withColumn("k", F.floor(F.col("event_id") / 2))
    kind = F.expr("CASE WHEN k % 3 = 0 THEN 'payment' ELSE 'refund' END")
    status = F.expr("CASE WHEN k % 3 = 0 THEN CASE k % 4 WHEN 2 THEN 'expired' WHEN 3 THEN 'failed' ELSE 'paid' END ELSE CASE WHEN k % 5 < 3 THEN 'succeeded' ELSE 'failed' END END")
    e = e.select(F.col("k").cast("string").alias("event_id"), F.floor(F.col("k") / 7).cast("string").alias("order_id"), kind.alias("kind"), status.alias("status"), (F.col("user_id") % 2 * 100 + 50).cast("long").alias("amount"), F.concat(F.lit("r"), F.col("k") % 7).alias("ref"), F.timestamp_seconds("event_id").alias("ts"))
    return S.orders_batch(e)


def account_plans(spark, d):
    grants = _orders(spark, d).select("account_id", F.col("o_orderpriority").alias("product"))
    plans = spark.createDataFrame(PLANS, "product string, priority int, most_chars int")
    return O.plans_of(grants, plans, {"light": 1, "deep": 2, "full": 4})


PLANS = [("1-URGENT", 4, 60_000), ("2-HIGH", 2, 30_000), ("3-MEDIUM", 2, 90_000), ("4-NOT SPECIFIED", 1, 3000)]


def failures_by_either(spark, d):
    e = _events(spark, d).select("event_id", "at", "user_id", F.when(F.col("event_type") != "view", F.col("event_id") % 60).alias("session"))
    return O.either_rate(e, ["user_id", "session"], 7 * 86_400, 30).select("event_id", "limited")


def traffic_all_time(spark, d):
    return O.all_time(R.traffic_daily(table(spark, d, "events")))


def id_kinds(spark, d):
    t = _events(spark, d).select("event_id", F.md5(F.col("event_id").cast("string")).alias("h"))
    text = F.expr("CASE event_id % 8 WHEN 0 THEN concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21)) WHEN 1 THEN 'ord_' || h WHEN 2 THEN 'ord_x' WHEN 3 THEN 'evt_' || h WHEN 4 THEN 'pi_1' WHEN 5 THEN 're_a b' WHEN 6 THEN upper(h) END")
    return t.select("event_id", O.id_kind(text).alias("kind"))


def model_bench(spark, d):
    runs = _events(spark, d).select(F.col("event_type").alias("model"), (F.col("cents") % 50).alias("drop"), (F.col("user_id") % 2 == 0).alias("accepted"), (F.col("event_id") % 3).alias("lost"), (F.col("event_id") % 5).alias("new"), (F.col("event_id") % 4).alias("ratio"), F.col("cents").alias("tokens"))
    return X.model_bench(runs, spark.createDataFrame([("click", 2.0), ("view", 4.0)], "model string, price_per_million double"))


def _q(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


ORDERS = f"SELECT o_orderkey AS order_id, o_custkey AS account_id, o_orderstatus, o_orderpriority, o_orderdate, {CENTS.format('o_totalprice')} AS amount FROM orders"
EVENTS = f"SELECT event_id, user_id, event_type, {CENTS.format('value')} AS cents, {SECONDS} AS sec FROM events"
RUNS = """SELECT user_id AS base, CASE event_id % 5 WHEN 0 THEN '00_base' WHEN 1 THEN 'ZZ_ALL_' || event_id ELSE 'v' || event_id END AS variant, CASE event_id % 5 WHEN 2 THEN 'BURST' ELSE event_type END AS rule,
    CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN '12' END AS score, event_type AS detector, event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 'P1' WHEN event_id % 5 = 2 THEN 'P2' ELSE 'P3' END AS priority FROM events"""
ATTEMPTS = """SELECT l_orderkey AS order_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS attempt_id, l_partkey AS created_at,
    CASE l_returnflag WHEN 'R' THEN 'succeeded' WHEN 'A' THEN 'failed' ELSE 'created' END AS status, CAST(l_quantity AS BIGINT) AS amount FROM lineitem"""
SESSIONS = f"SELECT user_id AS account_id, event_id, sec + event_id % 1000 * 100 AS expires_at, CASE WHEN event_type = 'click' THEN sec END AS revoked_at FROM ({EVENTS})"
REFUNDS = "SELECT user_id AS order_id, event_id % 40 AS attempt_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'submitted' WHEN 'view' THEN 'created' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status FROM events"
STATES = f"SELECT order_id, attempt_id, CASE WHEN bool_or(status = 'succeeded') THEN 'succeeded' ELSE max_by(status, seq) END AS status FROM ({REFUNDS}) GROUP BY 1, 2"
NAMES = [None, " Ann ", "x" * 121, "a\tb", "李雷"]
ACCOUNT_ROWS = ", ".join(f"({i}, {_q(ADDRESSES[i % len(ADDRESSES)])}, {_q(PATHS[i % len(PATHS)])}, {_q(NAMES[i % 5])})" for i in range(70))
SQL = {
    "owned_orders": f"SELECT order_id, account_id, amount FROM ({ORDERS}) WHERE account_id = 7 ORDER BY o_orderdate DESC, order_id DESC LIMIT 100",
    "oldest_queued": f"""SELECT user_id, job_id, queued_at FROM (SELECT user_id, event_id AS job_id, sec AS queued_at, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS n
        FROM ({EVENTS}) WHERE event_type = 'click') WHERE n = 1""",
    "soonest_expiry": """SELECT account_id, id, expires_at FROM (SELECT l_suppkey AS account_id, l_orderkey || '-' || l_linenumber AS id, l_partkey AS expires_at,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey || '-' || l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n = 1""",
    "pending_requests": "SELECT o_orderkey AS id, 'pending' AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50",
    "manifest_order": f"SELECT event_id, priority, base, variant FROM ({RUNS})",
    "tier_progress": f"SELECT priority, count(*) FILTER (score IS NOT NULL AND trim(score) <> '') AS done, count(*) AS total, count(DISTINCT detector) AS detectors FROM ({RUNS}) GROUP BY priority",
    "staff_grants": f"""SELECT event_id AS act_id, account_id, event_id AS grant_id, amount AS remaining, c_name AS actor_email FROM events JOIN ({ORDERS}) ON order_id = event_id
        LEFT JOIN customer ON c_custkey = user_id * 2""",
    "order_list": f"""WITH a AS ({ATTEMPTS}), s AS (SELECT order_id, CAST(sum(amount) AS BIGINT) AS refunded FROM a WHERE status = 'succeeded' GROUP BY 1),
        l AS (SELECT order_id, status FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, attempt_id DESC) AS n FROM a) WHERE n = 1)
        SELECT o.order_id, c_name AS email, o.amount, coalesce(refunded, 0) AS refunded, l.status AS last_attempt FROM ({ORDERS}) o LEFT JOIN customer ON c_custkey = account_id AND c_custkey % 3 > 0
        LEFT JOIN s ON s.order_id = o.order_id LEFT JOIN l ON l.order_id = o.order_id""",
    "net_sales": f"""SELECT substr(o_orderpriority, 1, 1) AS currency, count(*) AS n_orders, CAST(sum(amount - amount % 100) AS BIGINT) AS net FROM ({ORDERS}) WHERE order_id % 10 > 0 AND o_orderstatus <> 'O' GROUP BY 1""",
    "account_balances": f"""SELECT c_custkey AS account_id, CAST(coalesce(sum(amount % 1000 - 100) FILTER (amount % 1000 > 100 AND o_orderstatus <> 'F' AND (order_id % 2 = 1 OR order_id > 500)), 0) AS BIGINT) AS balance
        FROM customer LEFT JOIN ({ORDERS}) ON c_custkey = account_id GROUP BY 1""",
    "committed_tokens": f"SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(user_id), 0) AS BIGINT) AS output_tokens FROM ({EVENTS}) WHERE event_type = 'purchase'",
    "call_usage": f"SELECT event_id % 97 AS job_id, count(*) AS calls, count(*) FILTER (event_type = 'click') AS failed, CAST(sum(cents) AS BIGINT) AS tokens FROM ({EVENTS}) GROUP BY 1",
    "all_variant_bound": f"SELECT event_type AS detector, CAST(sum(cents % 100) AS DOUBLE) / count(*) AS bound, count(*) AS n FROM ({EVENTS}) WHERE user_id % 4 = 0 GROUP BY 1",
    "unresolved_disputes": "SELECT event_id, 'needs_response' AS status FROM events WHERE event_type NOT IN ('click', 'view')",
    "reconcile_run": """SELECT count(*) AS orders, count(*) FILTER (o_orderkey % 50 = 0) AS failed, count(*) FILTER (o_orderkey % 77 = 0) AS disputed,
        CAST(count(*) FILTER (o_orderkey % 50 = 0 OR o_orderkey % 77 = 0) > 0 AS INT) AS exit_code FROM orders""",
    "webhook_match": f"SELECT order_id, order_id % 9 = 0 OR order_id % 7 > 0 OR amount = 1 AS matches FROM ({ORDERS})",
    "staff_rows": f"SELECT order_id, account_id FROM ({ORDERS}) WHERE account_id = 7",
    "stale_releases": f"""SELECT event_id AS job_id, cents AS reserved FROM ({EVENTS}) WHERE event_type = 'view' AND sec < 1706000000 - 7200 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id)""",
    "recover_jobs": """SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' THEN 'wait' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) THEN 'finish' ELSE 'refund' END AS action
        FROM orders WHERE o_orderstatus <> 'F'""",
    "live_sessions": f"SELECT account_id, count(*) FILTER (revoked_at IS NULL AND expires_at > 1706000000) AS live, count(*) AS sessions FROM ({SESSIONS}) GROUP BY 1",
    "purgeable_sessions": f"SELECT event_id FROM ({SESSIONS}) WHERE least(expires_at, coalesce(revoked_at, expires_at)) < 1706000000 - 86400",
    "checkouts": """WITH f AS (SELECT user_id AS account_id, event_id % 3 AS key, event_id AS seq, event_type, first_value(event_type) OVER w AS first, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_id % 3 ORDER BY event_id))
        SELECT account_id, key, seq, CASE WHEN n = 1 THEN 'created' WHEN event_type = first THEN 'reused' ELSE 'conflict' END AS outcome FROM f""",
    "refund_attempts": STATES,
    "refund_locks": f"SELECT order_id, count(*) FILTER (status IN ('created', 'submitted', 'unknown')) AS n_open, n_open > 0 AS locked, n_open > 1 AS broken FROM ({STATES}) GROUP BY 1",
    "backfill_versions": """WITH n AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN lang || text ELSE text END AS source_text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
        SELECT doc_id, 1 AS revision, md5(source_text) AS text FROM n UNION ALL SELECT doc_id, 2, md5(text) FROM n WHERE text IS DISTINCT FROM source_text""",
    "retained_rows": """SELECT o_orderkey AS order_id, 'jobs' AS kind FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)
        UNION ALL SELECT o_orderkey, 'ledger' FROM orders WHERE o_orderkey % 2 = 0""",
    "newest_archive": f"""SELECT sec AS modified, 'backup-' || event_id AS path, cents AS length, sec BETWEEN 1706000000 - 86400 AND 1706000000 + 300 AS recent FROM ({EVENTS}) ORDER BY sec DESC, path DESC LIMIT 1""",
    "receipts": """SELECT CASE WHEN page_id % 10 = 3 THEN page_id || 'x' ELSE CAST(page_id AS VARCHAR) END AS path, CASE WHEN page_id % 10 = 3 THEN 'missing' WHEN page_id % 10 = 5 THEN 'different' ELSE 'ok' END AS state FROM pages""",
    "cursor_page": f"SELECT order_id AS id, amount FROM ({ORDERS}) WHERE order_id > 100 ORDER BY order_id LIMIT 60",
    "job_fingerprints": """SELECT doc_id, substr(sha256(source || chr(0) || doc_id), 1, 24) AS job, sha256('{"doc_id":[' || doc_id || '],"lang":["' || lang || '"]}') AS digest FROM documents""",
    "job_progress": f"""SELECT order_id, CAST(CASE WHEN amount % 80 > 0 THEN floor(least(order_id % 90, amount % 80) * 100 / (amount % 80)) ELSE 0 END AS INT) AS percent,
        round(greatest(amount - 1000000, 0) / 1000, 1) AS elapsed FROM ({ORDERS})""",
    "json_defaults": """SELECT event_id, coalesce(json_extract_string(props, '$.page'), 'none') AS page, 3 AS broken FROM events""",
    "account_text": f"""WITH t(id, address, path, name) AS (VALUES {ACCOUNT_ROWS}), c AS (SELECT *, lower(trim(address)) AS e, regexp_replace(path, '[?#].*$', '', 's') AS p FROM t)
        SELECT CAST(id AS BIGINT) AS id, CASE WHEN regexp_full_match(e, '[a-z0-9!#$%&''*+/=?^_`{{|}}~-]+(\\.[a-z0-9!#$%&''*+/=?^_`{{|}}~-]+)*@[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?)+') THEN e END AS email,
        CASE WHEN path LIKE '//%' OR contains(path, chr(92)) OR NOT regexp_full_match(p, '/[A-Za-z0-9_./-]*') THEN '/app' ELSE p END AS path,
        CASE WHEN len(trim(coalesce(name, ''))) <= 120 AND NOT regexp_matches(coalesce(name, ''), '[\\x00-\\x1f]') THEN trim(coalesce(name, '')) END AS name FROM c""",
    "money_text": f"""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN m < 0 THEN '-' ELSE '' END || CASE event_type WHEN 'click' THEN '¥' ELSE '$' END || format('{{:,}}', abs(m) // 100) || '.' || lpad(CAST(abs(m) % 100 AS VARCHAR), 2, '0')
        ELSE '—' END AS text FROM (SELECT event_id, event_type, cents * 1000 - 50000 AS m FROM ({EVENTS}))""",
    "account_plans": f"""WITH p(product, priority, most) AS (VALUES {', '.join(map(str, PLANS))}), h AS (SELECT account_id, p.* FROM ({ORDERS}) JOIN p ON product = o_orderpriority)
        SELECT account_id, max_by(product, priority * 10 + CAST(substr(product, 1, 1) AS INT)) AS plan, max(most) AS most_chars, list_filter(['light', 'deep', 'full'], lambda x: CASE x WHEN 'light' THEN 1 WHEN 'deep' THEN 2 ELSE 4 END <= max(priority)) AS strengths FROM h GROUP BY 1""",
    "failures_by_either": f"""WITH e AS (SELECT event_id, sec, user_id, CASE WHEN event_type <> 'view' THEN event_id % 60 END AS s FROM ({EVENTS})),
        c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS a, count(*) OVER (PARTITION BY s ORDER BY sec RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS b FROM e)
        SELECT event_id, a > 30 OR (s IS NOT NULL AND b > 30) AS limited FROM c""",
    "traffic_all_time": """SELECT min(day) AS since, count(DISTINCT day) AS days, count(*) AS views FROM (SELECT CAST(timezone('Asia/Shanghai', timezone('UTC', ts)) AS DATE) AS day FROM events)""",
    "id_kinds": "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'uuid' WHEN 1 THEN 'order' WHEN 3 THEN 'event' WHEN 4 THEN 'payment' WHEN 6 THEN 'key' END AS kind FROM events",
    "model_bench": f"""WITH r AS (SELECT event_type AS model, avg(CAST(cents % 50 AS DOUBLE)) AS "drop", avg(CAST(user_id % 2 = 0 AS DOUBLE)) AS accept, avg(CAST(event_id % 3 AS DOUBLE)) AS lost, avg(CAST(event_id % 5 AS DOUBLE)) AS new,
            avg(CAST(event_id % 4 AS DOUBLE)) AS ratio, CAST(sum(cents) AS BIGINT) AS tokens FROM ({EVENTS}) GROUP BY 1)
        SELECT *, CASE model WHEN 'click' THEN CAST(2 AS DOUBLE) WHEN 'view' THEN CAST(4 AS DOUBLE) END AS price_per_million, tokens * CASE model WHEN 'click' THEN CAST(2 AS DOUBLE) WHEN 'view' THEN CAST(4 AS DOUBLE) END / 1000000 AS cost FROM r""",
    "order_states": """WITH e AS (SELECT event_id AS n, event_id // 2 AS k, event_id // 2 // 7 AS o, CASE WHEN event_id // 2 % 3 = 0 THEN 'payment' ELSE 'refund' END AS kind,
            CASE WHEN event_id // 2 % 3 = 0 THEN CASE event_id // 2 % 4 WHEN 2 THEN 'expired' WHEN 3 THEN 'failed' ELSE 'paid' END ELSE CASE WHEN event_id // 2 % 5 < 3 THEN 'succeeded' ELSE 'failed' END END AS status,
            user_id % 2 * 100 + 50 AS amount, event_id // 2 % 7 AS ref FROM events),
        f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS i, first_value(amount) OVER (PARTITION BY k ORDER BY n) AS first FROM e),
        r AS (SELECT o, ref, max_by(status, n) AS status, max_by(amount, n) AS amount FROM f WHERE i = 1 AND kind = 'refund' GROUP BY 1, 2), t AS (SELECT o, sum(amount) FILTER (status = 'succeeded') AS back FROM r GROUP BY 1),
        p AS (SELECT o, min_by(amount, n) FILTER (i = 1 AND status = 'paid') AS paid, max_by(status, n) FILTER (i = 1 AND status IN ('expired', 'failed') AND kind = 'payment') AS closed,
            count(*) FILTER (i > 1 AND amount = first) AS duplicates, count(*) FILTER (i > 1 AND amount <> first) AS conflicts FROM f GROUP BY 1),
        x AS (SELECT p.*, CASE WHEN paid IS NULL THEN 0 ELSE coalesce(back, 0) END AS refunded FROM p LEFT JOIN t ON t.o = p.o)
        SELECT CAST(o AS VARCHAR) AS order_id, CASE WHEN paid IS NULL THEN coalesce(closed, 'pending') WHEN refunded >= paid THEN 'refunded' WHEN refunded > 0 THEN 'partially_refunded' ELSE 'paid' END AS status,
            CAST(coalesce(paid, 0) AS BIGINT) AS amount, CAST(refunded AS BIGINT) AS refunded, duplicates, conflicts FROM x""",
    "guarded_saves": """WITH RECURSIVE e AS (SELECT user_id AS doc_id, event_id AS seq, event_id % 3 AS expected, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        f AS (SELECT doc_id, 0 AS n, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS rev, CAST(NULL AS VARCHAR) AS t, false AS taken FROM e WHERE n = 1
            UNION ALL SELECT e.doc_id, e.n, e.seq, CASE WHEN e.expected = f.rev AND e.t IS DISTINCT FROM f.t THEN f.rev + 1 ELSE f.rev END, CASE WHEN e.expected = f.rev THEN e.t ELSE f.t END, e.expected = f.rev FROM f JOIN e ON e.doc_id = f.doc_id AND e.n = f.n + 1)
        SELECT doc_id, seq, rev AS revision, taken FROM f WHERE n > 0""",
}
QUERIES = {name: globals()[name] for name in SQL}
