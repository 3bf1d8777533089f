"""Gates, quotes, reservations and queues of the operational model: ordered decisions as columns, folds as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(*gates: tuple[Column, str]) -> Column:
    """The reason of the first gate that holds; null if none does."""
    out = F.lit(None).cast("string")
    for holds, reason in reversed(gates):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def job_gate(strength_allowed: Column, units: Column, most_units: Column, required: Column, balance: Column) -> Column:
    """Why a job is refused: strength, size, empty text, balance, in this order."""
    return first_reason((~strength_allowed, "strength"), (units > most_units, "size"), (units <= 0, "empty"), (required > balance, "balance"))


def refund_gate(live: Column, status: Column, amount: Column, remaining: Column, open_attempts: Column, provider_total: Column, booked: Column) -> Column:
    """Why a refund is refused: mode, status, amount, an open attempt, totals that differ, in this order."""
    paid = status.isin("paid", "partially_refunded")
    return first_reason((~live, "mode"), (~paid, "status"), ((amount <= 0) | (amount > remaining), "amount"), (open_attempts > 0, "open_attempt"), (provider_total != booked, "reconcile"))


def pending_orders(orders: DataFrame, now: int, patience: int = 1800) -> DataFrame:
    """Pending orders whose checkout has not expired, or that never got one and are younger than ``patience`` seconds."""
    alive = F.when(F.col("expires_at").isNotNull(), F.col("expires_at") > now).otherwise(F.col("created_at") > now - patience)
    return orders.where((F.col("status") == "pending") & alive)


def quotes(products: DataFrame, prices: DataFrame, currency: str) -> DataFrame:
    """Each product's price in one currency; null where there is none, never converted."""
    own = prices.where(F.col("currency") == currency).select("product", "amount")
    return products.join(own, "product", "left").select("product", F.lit(currency).alias("currency"), "amount")


def metering_version(snapshot: Column) -> Column:
    """The version that an order's JSON names; 1 if it names none or is no JSON."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(snapshot), "$.metering_version", "int"), F.lit(1))


def rejects(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that fail a check, with the first one's name."""
    return df.withColumn("reject", first_reason(*[(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()])).where("reject IS NOT NULL")


def ledger_totals(entries: DataFrame, key: str, delta: str) -> DataFrame:
    d = F.col(delta)
    return entries.groupBy(key).agg(F.sum(F.greatest(d, F.lit(0))).alias("increases"), F.sum(F.abs(F.least(d, F.lit(0)))).alias("decreases"))


def settle(reservations: DataFrame) -> DataFrame:
    """Each job's final state of events ``job_id, seq, kind, amount`` (reserve, commit, release): the first terminal event holds,
    replays change nothing; ``charged`` is what a commit keeps, ``returned`` the rest."""
    order = F.struct("seq")
    per = reservations.groupBy("job_id").agg(
        F.min_by(F.when(F.col("kind") == "reserve", F.col("amount")), F.when(F.col("kind") == "reserve", order)).alias("reserved"),
        F.min_by(F.col("kind"), F.when(F.col("kind") != "reserve", order)).alias("closed"),
        F.min_by(F.col("amount"), F.when(F.col("kind") == "commit", order)).alias("used"),
    )
    kept = per.where("reserved IS NOT NULL")
    charged = F.when(F.col("closed") == "commit", F.least("reserved", F.coalesce("used", "reserved"))).otherwise(F.lit(0))
    out = kept.withColumn("charged", F.when(F.col("closed").isNull(), F.lit(0)).otherwise(charged))
    return out.select("job_id", "reserved", F.coalesce("closed", F.lit("open")).alias("state"), "charged", F.when(F.col("closed").isNull(), F.lit(0)).otherwise(F.col("reserved") - F.col("charged")).alias("returned"))


def queue_depth(jobs: DataFrame, slot: int = 900) -> DataFrame:
    """Jobs waiting when each one comes, itself included, of ``job_id, queued_at, started_at``; summed by slots of so many seconds first."""
    come = jobs.select("job_id", F.col("queued_at").alias("at"), F.lit(1).alias("step"))
    go = jobs.where("started_at IS NOT NULL").select(F.lit(None).cast("long").alias("job_id"), F.col("started_at").alias("at"), F.lit(-1).alias("step"))
    both = come.unionByName(go).withColumn("slot", F.floor(F.col("at") / slot))
    before = both.groupBy("slot").agg(F.sum("step").alias("net"))
    carried = before.withColumn("carried", F.coalesce(F.sum("net").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("slot").orderBy("at", "step", F.coalesce("job_id", F.lit(-1))).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("depth", F.sum("step").over(w)).join(carried, "slot").where("job_id IS NOT NULL").select("job_id", (F.col("depth") + F.col("carried")).alias("depth"))


def challenge(attempts: DataFrame, most: int = 5, seconds: int = 600) -> DataFrame:
    """One-time challenges: the first right answer within ``most`` attempts and ``seconds`` passes; nothing later does."""
    w = Window.partitionBy("challenge_id").orderBy("at", "attempt_id")
    a = attempts.withColumn("n", F.row_number().over(w))
    ok = (F.col("n") <= most) & (F.col("at") - F.col("created_at") <= seconds) & F.col("right")
    return a.groupBy("challenge_id").agg(F.count("*").alias("attempts"), F.min(F.when(ok, F.col("n"))).alias("passed_at")).withColumn("passed", F.col("passed_at").isNotNull())


def deletion_blockers(accounts: DataFrame, jobs: DataFrame, orders: DataFrame, balances: DataFrame) -> DataFrame:
    """What keeps each account from being deleted: live jobs, pending orders, paid balance."""
    out = accounts.select("account_id")
    for name, df in (("jobs", jobs), ("orders", orders), ("balance", balances)):
        out = out.join(df.groupBy("account_id").agg(F.count("*").alias(name)), "account_id", "left")
    flags = [F.when(F.col(n) > 0, F.lit(n)) for n in ("jobs", "orders", "balance")]
    return out.select("account_id", F.array_compact(F.array(*flags)).alias("blockers"))


def paragraph_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paragraphs of two versions by place: a side that is missing shows that the counts differ."""
    a = left.select("doc_id", "para", F.col("text").alias("before"))
    b = right.select("doc_id", "para", F.col("text").alias("after"))
    return a.join(b, ["doc_id", "para"], "full").withColumn("same", F.col("before").eqNullSafe(F.col("after")))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` beyond those of ``b``, with their numbers."""
    keys = a.columns
    n = a.groupBy(*keys).agg(F.count("*").alias("x")).join(b.groupBy(*keys).agg(F.count("*").alias("y")), keys, "left")
    return n.select(*keys, (F.col("x") - F.coalesce("y", F.lit(0))).alias("n")).where("n > 0")


def fingerprint(*parts: Column) -> Column:
    """The SHA-256 of parts with zero bytes between them."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def token_estimate(text: Column) -> Column:
    """A Han character is a token, four others are one."""
    han = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    return (han + F.floor((F.length(text) - han) / 4)).cast("long")
