"""Joins, sets, windows and aggregates of the operational model, as DataFrame functions.

``now`` is always a parameter, money and credits are integers, and no function collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


# --- traffic -------------------------------------------------------------------------------------------------------


def local_day(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def traffic_daily(events: DataFrame, routes: list[str] | None = None, zone: str = "Asia/Shanghai") -> DataFrame:
    """Views by local day and allowed route."""
    seen = events if routes is None else events.where(F.col("event_type").isin(routes))
    return seen.groupBy(local_day(F.col("ts"), zone).alias("day"), F.col("event_type").alias("route")).agg(F.count("*").alias("views"))


def gap_filled(daily: DataFrame, last: str, days: int) -> DataFrame:
    """Exactly ``days`` rows up to and with ``last``; 0 where nothing was seen."""
    spark = daily.sparkSession
    series = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias("day"))
    total = daily.groupBy("day").agg(F.sum("views").alias("views"))
    return series.join(total, "day", "left").select("day", F.coalesce("views", F.lit(0)).alias("views"))


def top_routes(daily: DataFrame, k: int = 10) -> DataFrame:
    return daily.groupBy("route").agg(F.sum("views").alias("views")).orderBy(F.desc("views"), "route").limit(k)


# --- rates ---------------------------------------------------------------------------------------------------------


def rate_window(events: DataFrame, seconds: int, most: int, key: str = "user_id") -> DataFrame:
    """Events of a key in the ``seconds`` up to each event, and whether that is over ``most``."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy(key).orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    counted = events.select(key, "event_id", at.alias("at")).withColumn("n", F.count("*").over(frame))
    return counted.select("event_id", key, "n", (F.col("n") > most).alias("limited"))


def cooldown(events: DataFrame, seconds: int, key: str = "user_id") -> DataFrame:
    """Seconds since the key's event before, and whether they fall short of ``seconds``."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.expr(f"(at - lag(at) OVER (PARTITION BY `{key}` ORDER BY at, event_id)) div 1000000")
    e = events.select("event_id", key, at.alias("at")).withColumn("gap", before)
    return e.select("event_id", key, "gap", F.coalesce(F.col("gap") < seconds, F.lit(False)).alias("blocked"))


# --- events --------------------------------------------------------------------------------------------------------


def fold_idempotent(events: DataFrame, key: str, payload: list[str], order: list[str]) -> DataFrame:
    """One row for each key: its first event, how many repeat it and how many contradict it."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in payload]), 256)
    held = events.select(key, digest.alias("payload"), F.struct(*order).alias("o"))
    first = held.groupBy(key).agg(F.min_by("payload", "o").alias("first"))
    both = held.groupBy(key, "payload").agg(F.count("*").alias("n")).join(first, key)
    return both.groupBy(key).agg(
        F.sum(F.when(F.col("payload") == F.col("first"), F.col("n") - 1).otherwise(0)).alias("duplicates"),
        F.sum(F.when(F.col("payload") != F.col("first"), F.col("n")).otherwise(0)).alias("conflicts"),
    )


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def first_occurrence(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def revisions(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the key's row before, numbered from 1."""
    w = Window.partitionBy(key).orderBy(order)
    changed = df.withColumn("__last", F.lag(value).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    kept = changed.where(F.col("__first") | ~F.col(value).eqNullSafe(F.col("__last")))
    return kept.withColumn("revision", F.row_number().over(w)).drop("__last", "__first")


# --- accounts ------------------------------------------------------------------------------------------------------


def search_page(accounts: DataFrame, nations: DataFrame, query: str, limit: int, offset: int) -> DataFrame:
    """Accounts with a name, segment or nation that holds ``query`` literally, in order; limit 1 to 100, offset from 0."""
    limit, offset, q = max(1, min(100, limit)), max(0, offset), query.lower()
    both = accounts.join(nations, accounts.c_nationkey == nations.n_nationkey)
    hit = F.lit(not q)
    for c in ("c_name", "c_mktsegment", "n_name"):
        hit = hit | F.lower(F.col(c)).contains(q)
    return both.where(hit).select("c_custkey", "c_name", "c_mktsegment", "n_name").orderBy("c_custkey").offset(offset).limit(limit)


def account_overview(accounts: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders, open orders and cents of each account; accounts without orders have 0."""
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.sum(cents(F.col("o_totalprice"))).alias("cents")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_orders", "n_open", "cents")]
    return accounts.select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", *zero)


def sales_by(orders: DataFrame, column: str, statuses: list[str]) -> DataFrame:
    """Orders and cents by currency (here: any column); never summed across."""
    kept = orders.where(F.col("o_orderstatus").isin(statuses))
    return kept.groupBy(F.col(column).alias("currency")).agg(F.count("*").alias("n_orders"), F.sum(cents(F.col("o_totalprice"))).alias("cents"))


def state_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("state")).agg(F.count("*").alias("n"))


def without_any(df: DataFrame, key: str, others: list[DataFrame]) -> DataFrame:
    """Rows whose key is in none of the others (each with a column of that name)."""
    for other in others:
        df = df.join(other.select(key), key, "left_anti")
    return df


# --- ledger --------------------------------------------------------------------------------------------------------


def active(remaining: str, revoked: str, expires: str, now: int) -> Column:
    return (F.col(remaining) > 0) & F.col(revoked).isNull() & (F.col(expires).isNull() | (F.col(expires) > now))


def fifo_allocation(grants: DataFrame, required: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """What each grant (``key, remaining``) gives towards its account's ``required``, in order until it is met."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("remaining").over(w), F.lit(0))
    both = grants.withColumn("before", before).join(required.select(key, "required"), key)
    return both.withColumn("take", F.greatest(F.lit(0), F.least(F.col("remaining"), F.col("required") - F.col("before")))).drop("before", "required")


def running_balance(entries: DataFrame, key: str, order: list[str], delta: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("balance", F.sum(delta).over(w))


def grant_recalc(grants: DataFrame, allocations: DataFrame, live: list[str], now: int | None = None) -> DataFrame:
    """``remaining = max(0, granted - refunded - live allocations)`` of each grant; with ``now`` those that are revoked or expired
    (``revoked_at``, ``expires_at``) keep what they had in ``remaining``."""
    used = allocations.where(F.col("status").isin(live)).groupBy("grant_id").agg(F.sum("amount").alias("used"))
    rest = F.greatest(F.lit(0), F.col("granted") - F.col("refunded") - F.coalesce("used", F.lit(0)))
    if now is not None:
        over = F.col("revoked_at").isNotNull() | F.coalesce(F.col("expires_at") <= now, F.lit(False))
        rest = F.when(over, F.col("remaining")).otherwise(rest)
    return grants.join(used, "grant_id", "left").select("grant_id", rest.alias("remaining"))


def reserved_credits(units: Column, multiplier_milli: Column) -> Column:
    """Units times a multiplier in thousandths, rounded up."""
    return F.floor((units * multiplier_milli + 999) / 1000).cast("long")


def prorated(credits: str, refunded: str, amount: str) -> Column:
    """credits * refunded div amount, in integers; 0 for an amount of 0."""
    return F.expr(f"CASE WHEN `{amount}` = 0 THEN 0 ELSE (`{credits}` * `{refunded}`) div `{amount}` END")


def net_of_refunds(orders: DataFrame, refunds: DataFrame, key: str) -> DataFrame:
    """Each order's amount, refunds by provider, and whether they differ from what is booked."""
    total = refunds.groupBy(key).agg(F.sum("amount").alias("refunded"), F.count_distinct("currency").alias("currencies"))
    both = orders.join(total, key, "left").withColumn("refunded", F.coalesce("refunded", F.lit(0)))
    off = (F.col("refunded") != F.col("booked")) | (F.coalesce("currencies", F.lit(1)) != 1)
    return both.select(key, "amount", "refunded", off.alias("reconciliation_required"))


# --- top-k ---------------------------------------------------------------------------------------------------------


def arg_max(df: DataFrame, group: str, value: Column, by: list[Column], name: str) -> DataFrame:
    """The value of each group's row with the largest ``by``; put the tie-breaker last in it."""
    return df.groupBy(group).agg(F.max_by(value, F.struct(*by)).alias(name))


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
