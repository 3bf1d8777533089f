"""Jobs, orders, refunds, sessions, backups and account rows: joins, folds and lists of the operational model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest

# States of orders, disputes and refund attempts, and priorities of experiments.
LIVE_ORDERS = ["paid", "partially_refunded"]
SETTLED_DISPUTES = ["won", "warning_closed"]
OPEN_ATTEMPTS = ["created", "submitted", "unknown"]
SYMBOLS = {"CNY": "¥", "USD": "$"}


# --- lists -------------------------------------------------------------------------------------------------------------


def owned(df: DataFrame, owner: str, account, order: list[Column], limit: int, most: int = 100) -> DataFrame:
    """An account's rows in order, 1 to ``most`` of them."""
    return df.where(F.col(owner) == account).orderBy(*order).limit(max(1, min(most, limit)))


def oldest_queued(jobs: DataFrame, key: str) -> DataFrame:
    """The next job of each key: queued, oldest first, then by id."""
    return jobs.where("state = 'queued'").groupBy(key).agg(F.min(F.struct("queued_at", "job_id")).alias("j")).select(key, "j.job_id", "j.queued_at")


def soonest_expiry(grants: DataFrame, key: str) -> DataFrame:
    """The grant of each key that expires first; grants without expiry are none."""
    return grants.where("expires_at IS NOT NULL").groupBy(key).agg(F.min(F.struct("expires_at", "id")).alias("g")).select(key, "g.id", "g.expires_at")


def pending_first(requests: DataFrame, limit: int) -> DataFrame:
    """Pending requests, the oldest first."""
    return requests.where("status = 'pending'").orderBy("created_at", "id").limit(limit)


def manifest_order(runs: DataFrame) -> DataFrame:
    """Experiment runs with priority, in the order they are to be done: bases and full clean-ups, then the counter-test, then single features."""
    first = (F.col("variant") == "00_base") | F.col("variant").startswith("ZZ_ALL")
    tier = F.when(first, "P1").when(F.col("rule") == "BURST", "P2").otherwise("P3")
    return runs.withColumn("priority", tier).orderBy("priority", "base", "variant")


def tier_progress(runs: DataFrame) -> DataFrame:
    """Scored and all runs of each priority, and how many detectors scored them."""
    done = F.col("score").isNotNull() & (F.trim("score") != "")
    return runs.groupBy("priority").agg(F.count_if(done).alias("done"), F.count("*").alias("total"), F.count_distinct("detector").alias("detectors"))


# --- joins and sums ------------------------------------------------------------------------------------------------------


def granted_by_staff(acts: DataFrame, grants: DataFrame, profiles: DataFrame) -> DataFrame:
    """Grants that staff made, with what is left of each and the actor's address, if it is known."""
    own = grants.select("grant_id", "account_id", "remaining")
    who = profiles.select(F.col("account_id").alias("actor_id"), F.col("email").alias("actor_email"))
    return acts.join(own, "grant_id").join(who, "actor_id", "left").select("act_id", "account_id", "grant_id", "remaining", "actor_email")


def order_list(orders: DataFrame, profiles: DataFrame, attempts: DataFrame) -> DataFrame:
    """Orders with the buyer's address, what refunds succeeded, and the last attempt's status."""
    done = attempts.where("status = 'succeeded'").groupBy("order_id").agg(F.sum("amount").alias("refunded"))
    last = latest(attempts, "order_id", [F.desc("created_at"), F.desc("attempt_id")]).select("order_id", F.col("status").alias("last_attempt"))
    both = orders.join(profiles.select("account_id", "email"), "account_id", "left").join(done, "order_id", "left").join(last, "order_id", "left")
    return both.select("order_id", "email", "amount", F.coalesce("refunded", F.lit(0)).alias("refunded"), "last_attempt")


def net_sales(orders: DataFrame) -> DataFrame:
    """Live orders and their amounts less refunds, by currency."""
    kept = orders.where(F.col("live") & F.col("status").isin(LIVE_ORDERS))
    return kept.groupBy("currency").agg(F.count("*").alias("n_orders"), F.sum(F.col("amount") - F.col("refunded")).alias("net"))


def balances(grants: DataFrame, accounts: DataFrame, now: int) -> DataFrame:
    """What each account may spend: the rest of grants that are neither revoked nor expired; 0 without any."""
    alive = (F.col("remaining") > 0) & F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    per = grants.where(alive).groupBy("account_id").agg(F.sum("remaining").alias("balance"))
    return accounts.select("account_id").join(per, "account_id", "left").fillna(0, ["balance"])


def committed_tokens(reservations: DataFrame) -> DataFrame:
    """Tokens of committed jobs, in and out."""
    return reservations.where("status = 'committed'").agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def call_usage(calls: DataFrame) -> DataFrame:
    """Calls, failures and tokens of each job's model calls."""
    return calls.groupBy("job_id").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum("tokens").alias("tokens"))


def all_variant_bound(deltas: DataFrame) -> DataFrame:
    """The mean drop of full clean-ups by detector: the most that any single rule can show."""
    return deltas.where("rule = 'ALL'").groupBy("detector").agg(F.avg("delta").alias("bound"), F.count("*").alias("n"))


def unresolved(disputes: DataFrame) -> DataFrame:
    return disputes.where(~F.col("status").isin(SETTLED_DISPUTES))


def reconcile(results: DataFrame) -> DataFrame:
    """An hourly run's outcome of ``order_id, ok, disputed``: it goes on after errors and fails as a whole if any is left."""
    per = results.agg(F.count("*").alias("orders"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("disputed").alias("disputed"))
    return per.withColumn("exit_code", ((F.col("failed") > 0) | (F.col("disputed") > 0)).cast("int"))


def matches_order(fields: list[str]) -> Column:
    """Whether a webhook's fields (``w_`` columns) all equal the order's, null like null."""
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"w_{f}").eqNullSafe(F.col(f))
    return out


def staff_only(df: DataFrame, owner: str, account, staff: list) -> DataFrame:
    """All rows for staff, an account's own for others."""
    return df.where(F.lit(account in staff) | (F.col(owner) == account))


def plans_of(grants: DataFrame, plans: DataFrame, strengths: dict[str, int]) -> DataFrame:
    """Each account's plan (of its paid grants the one of highest priority), its longest job, and the strengths that priority allows."""
    held = grants.join(plans, "product")
    per = held.groupBy("account_id").agg(F.max_by("product", F.struct("priority", "product")).alias("plan"), F.max("priority").alias("priority"), F.max("most_chars").alias("most_chars"))
    allowed = F.array_compact(F.array(*[F.when(F.col("priority") >= least, F.lit(name)) for name, least in strengths.items()]))
    return per.select("account_id", "plan", "most_chars", allowed.alias("strengths"))


def either_rate(events: DataFrame, keys: list[str], seconds: int, most: int) -> DataFrame:
    """Events whose any key had more than ``most`` events in the ``seconds`` up to it; null keys count for none.

    Rows of one time count for each other. More than ``most`` of a sorted key's rows are near if the one ``most`` places before the last of
    that time is, so each row looks at one other and not at all that are near. Rows without a time only count for each other.
    """
    over = F.lit(False)
    for i, k in enumerate(keys):
        own = [k, F.when(F.col(k).isNull(), F.hash("at"))]  # rows without a key need not meet
        events = events.withColumn(f"__back{i}", F.lag("at", most).over(Window.partitionBy(*own).orderBy("at")))
        peers = Window.partitionBy(*own, "at")
        near = F.when(F.col("at").isNull(), F.count("*").over(peers) > most).otherwise(F.coalesce(F.max(f"__back{i}").over(peers) >= F.col("at") - seconds, F.lit(False)))
        events = events.withColumn(f"__over{i}", F.col(k).isNotNull() & near)
        over = over | F.col(f"__over{i}")
    return events.withColumn("limited", over).drop(*[f"__{c}{i}" for c in ("back", "over") for i in range(len(keys))])


def all_time(daily: DataFrame) -> DataFrame:
    """The first day, the days with views and all views of ``day, views``."""
    return daily.agg(F.min("day").alias("since"), F.count_distinct("day").alias("days"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"))


# How ids of each kind are written.
IDS = {
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "order": r"^ord_[0-9a-f]{32}$",
    "event": r"^evt_[A-Za-z0-9_]+$",
    "payment": r"^pi_[A-Za-z0-9_]+$",
    "refund": r"^re_[A-Za-z0-9_]+$",
    "key": r"^[A-Za-z0-9_-]{8,100}$",
}


def id_kind(text: Column) -> Column:
    """The first kind of id that a text is written like; null if it is none."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in IDS.items()])


# --- folds -----------------------------------------------------------------------------------------------------------------


def stale_releases(reservations: DataFrame, live: DataFrame, now: int, patience: int = 7200) -> DataFrame:
    """Reservations to release: still held, older than ``patience`` seconds, and no live job has them."""
    old = reservations.where((F.col("status") == "reserved") & (F.col("created_at") < now - patience))
    return old.join(live.select("job_id"), "job_id", "left_anti").select("job_id", "reserved")


def recover(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """What a restart does with each job that was running: ``finish`` it if its result is saved, else ``refund`` it; queued jobs ``wait``."""
    saved = results.select("job_id").distinct().withColumn("saved", F.lit(True))
    act = F.when(F.col("state") == "queued", "wait").when(F.col("saved"), "finish").otherwise("refund")
    return jobs.where(F.col("state").isin("queued", "running")).join(saved, "job_id", "left").select("job_id", act.alias("action"))


def guarded_saves(saves: DataFrame) -> DataFrame:
    """Saves ``doc_id, seq, expected, text`` in order: one is taken if it expects the current revision, which rises if the text changed.

    What is taken depends on what was taken before, so this is a fold over each document's saves.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        revision, last, out = 0, None, []
        pdf = pdf.sort_values("seq")
        for expected, text in zip(pdf["expected"], pdf["text"], strict=True):
            taken = expected == revision
            if taken and text != last:
                revision, last = revision + 1, text
            out.append((revision, taken))
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "seq": pdf["seq"].to_numpy(), "revision": [r for r, _ in out], "taken": [t for _, t in out]})

    kind = saves.schema["doc_id"].dataType.simpleString()
    return saves.groupBy("doc_id").applyInPandas(fold, f"doc_id {kind}, seq long, revision long, taken boolean")


def live_sessions(sessions: DataFrame, now: int) -> DataFrame:
    """Sessions that are neither revoked nor over, by account."""
    alive = F.col("revoked_at").isNull() & (F.col("expires_at") > now)
    return sessions.groupBy("account_id").agg(F.count_if(alive).alias("live"), F.count("*").alias("sessions"))


def purgeable(sessions: DataFrame, now: int, keep: int = 86_400) -> DataFrame:
    """Sessions whose end, or revocation, is more than ``keep`` seconds ago."""
    return sessions.where(F.least("expires_at", F.coalesce("revoked_at", "expires_at")) < now - keep)


def checkouts(requests: DataFrame) -> DataFrame:
    """Checkout requests ``account_id, key, seq, product, currency, provider``: the first of a key makes an order, equal ones reuse it, others conflict."""
    w = Window.partitionBy("account_id", "key").orderBy("seq")
    what = F.struct("product", "currency", "provider")
    first = F.first(what).over(w.rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(F.row_number().over(w) == 1, "created").when(first.eqNullSafe(what), "reused").otherwise("conflict")
    return requests.withColumn("outcome", outcome).select("account_id", "key", "seq", "outcome")


def refund_attempts(events: DataFrame) -> DataFrame:
    """Each attempt's state of events ``order_id, attempt_id, seq, status``: the last status holds, but success is final."""
    won = F.max((F.col("status") == "succeeded").cast("int")) == 1
    return events.groupBy("order_id", "attempt_id").agg(F.when(won, F.lit("succeeded")).otherwise(F.max_by("status", "seq")).alias("status"))


def refund_locks(attempts: DataFrame) -> DataFrame:
    """Orders with how many attempts are open; one locks the order, more break the rule."""
    per = attempts.groupBy("order_id").agg(F.count_if(F.col("status").isin(OPEN_ATTEMPTS)).alias("n_open"))
    return per.withColumns({"locked": F.col("n_open") > 0, "broken": F.col("n_open") > 1})


def backfill_versions(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Revisions that a migration adds: of a document without any its source as the first, its text as the second if it differs."""
    none = docs.join(versions.select("doc_id").distinct(), "doc_id", "left_anti")
    first = none.select("doc_id", F.lit(1).alias("revision"), F.col("source_text").alias("text"))
    second = none.where(~F.col("text").eqNullSafe(F.col("source_text"))).select("doc_id", F.lit(2).alias("revision"), "text")
    return first.unionByName(second)


def retained_after_deletion(tables: dict[str, DataFrame], gone: DataFrame, financial: list[str]) -> dict[str, DataFrame]:
    """Each table without the rows of deleted accounts; financial tables keep theirs."""
    ids = gone.select("account_id")
    return {name: df if name in financial else df.join(ids, "account_id", "left_anti") for name, df in tables.items()}


# --- backups and pages -------------------------------------------------------------------------------------------------------


def newest_archive(files: DataFrame, now: int, most_age: int, ahead: int = 300) -> DataFrame:
    """The newest archive of ``path, modified, length``, and whether it is recent: at most ``most_age`` seconds old, ``ahead`` in the future."""
    last = files.agg(F.max(F.struct("modified", "path", "length")).alias("f")).where("f IS NOT NULL").select("f.*")
    return last.withColumn("recent", F.col("modified").between(now - most_age, now + ahead))


def verify_receipts(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """Each receipt ``path, sha256, length`` against the file it names: ``ok``, ``missing`` or ``different``."""
    both = receipts.select("path", F.col("sha256").alias("want"), F.col("length").alias("size")).join(files.select("path", "sha256", "length"), "path", "left")
    state = F.when(F.col("sha256").isNull(), "missing").when((F.col("sha256") == F.col("want")) & (F.col("length") == F.col("size")), "ok").otherwise("different")
    return both.select("path", state.alias("state"))


def page_of(listed: DataFrame, after, size: int = 100) -> DataFrame:
    """A page of a list by cursor: the rows behind the id ``after`` (null: the first)."""
    return (listed if after is None else listed.where(F.col("id") > after)).orderBy("id").limit(max(1, min(100, size)))


# --- scalars -------------------------------------------------------------------------------------------------------------------


def job_key(account: Column, key: Column) -> Column:
    """A job's id that a repeated request gets again: 24 hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("\0", account, key), 256), 1, 24)


def canonical_digest(fields: list[str]) -> Column:
    """The SHA-256 of a row as JSON with its keys in order and nulls kept."""
    pairs = [F.concat(F.lit(f'"{f}":'), F.coalesce(F.to_json(F.array(F.col(f))), F.lit("[null]"))) for f in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")), 256)


def progress(done: Column, total: Column, started: Column, now: Column) -> Column:
    """Percent done, in whole numbers from 0 to 100, and seconds since the start with one decimal."""
    share = F.when(total > 0, F.floor(F.least(done, total) * 100 / total)).otherwise(0).cast("int")
    return F.struct(share.alias("percent"), F.round(F.greatest(now - started, F.lit(0)) / 1000, 1).alias("elapsed"))


def json_field(text: Column, path: str, kind: str, default) -> Column:
    """A field of a JSON text, or a default if the text or the field is none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), path, kind), F.lit(default))


# What an address and an internal path may be made of.
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def email(address: Column) -> Column:
    """An address in lower case without blanks around it, null if it is none; dots and tags stay. International domains are not mapped."""
    own = F.lower(F.trim(address))
    fits = own.rlike(rf"^(?=.{{1,64}}@){_ATOM}(?:\.{_ATOM})*@{_LABEL}(?:\.{_LABEL})+$") & (F.length(own) <= 254)
    return F.when(fits, own)


def display_name(name: Column) -> Column:
    """A name without blanks around it, empty for null; null if it is longer than 120 or holds control characters."""
    own = F.trim(F.coalesce(name, F.lit("")))
    return F.when((F.length(own) <= 120) & ~own.rlike(r"[\x00-\x1f]"), own)


def return_path(path: Column) -> Column:
    """An internal path without query and fragment; ``/app`` for anything that could lead elsewhere."""
    own = F.regexp_replace(path, r"(?s)[?#].*$", "")
    bad = path.startswith("//") | path.rlike(r"[\\\r\n]") | ~own.rlike(r"^/[A-Za-z0-9_./-]*$")
    return F.when(F.coalesce(bad, F.lit(True)), F.lit("/app")).otherwise(own)


def money(minor: Column, currency: Column) -> Column:
    """An amount in minor units with its currency's sign and two decimals; a dash for other currencies or none."""
    code = F.upper(F.coalesce(currency, F.lit("")))
    sign = F.element_at(F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair]), code)
    whole = F.format_number(F.abs(minor).cast("decimal(20,0)") / 100, 2)
    return F.coalesce(F.concat(F.when(minor < 0, "-").otherwise(""), sign, whole), F.lit("—"))
