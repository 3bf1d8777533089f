"""Payments, refunds and use of credits as one keyed state: typed maps in the state store, timers that compact them, and the same result as a batch.

Everything hangs on a payment's id, which refunds and payments carry, so a refund that comes before its payment waits in the
same key. What an order is worth is a function of the set of its events, never of the order in which they came: of an event id the
earliest content counts, of a refund or a use its latest event. The batch says that with aggregates, the stream with maps of which a batch
rewrites only the entries that changed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: kind is payment (paid, expired, failed), refund (pending, succeeded, failed, canceled) or use (reserved, committed, released); ref names the refund or
#: the job, amount is minor units or, of a use, credits; credits are what a payment grants.
EVENTS = "event_id string, payment string, order_id string, kind string, status string, amount long, credits long, ref string, ts timestamp"
SETTLED = (
    "payment string, order_id string, status string, amount long, refunded long, credits long, refunded_credits long, used long, remaining long, "
    "waiting long, duplicates long, conflicts long"
)
_CONTENT = ["order_id", "kind", "status", "amount", "credits", "ref"]
USED = ("reserved", "committed")
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_typed_state(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep their state in the store that typed maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def digest() -> Column:
    """What an event says, without its time; null fields count as such."""
    return F.sha2(F.to_json(F.struct(*_CONTENT), {"ignoreNullFields": "false"}), 256)


def _values(paid, closed, refunds: list[tuple[str, int]], used: list[tuple[str, int]]) -> dict:
    """The state of a payment; paid is (order_id, amount, credits) or None, closed (order_id, status) or None."""
    back = sum(a for s, a in refunds if s == "succeeded")
    spent = sum(a for s, a in used if s in USED)
    if paid is None:
        order, status = closed or (None, "pending_order" if refunds else "pending")
        return {"order_id": order, "status": status, "amount": 0, "refunded": 0, "credits": 0, "refunded_credits": 0, "used": spent, "remaining": 0, "waiting": back}
    order, amount, credits = paid
    if back > amount:
        status, gone = "mismatch", credits
    else:
        status = "refunded" if back == amount else "partially_refunded" if back else "paid"
        gone = credits if back == amount else credits * back // amount
    return {
        "order_id": order, "status": status, "amount": amount, "refunded": back, "credits": credits, "refunded_credits": gone, "used": spent,
        "remaining": max(0, credits - gone - spent), "waiting": 0,
    }


def settled(events: DataFrame) -> DataFrame:
    """SETTLED of every payment of EVENTS, as aggregates.

    Of an event id the content of the earliest row counts (ties: the smaller digest); equal ones after it are duplicates, others conflicts, and
    neither changes anything. Credits that a refund takes are credits * refunded div amount, all of them when everything is refunded; a refund that
    fails later gives them back, but never what is used. Refunds without a payment wait. More refunded than paid is a mismatch that leaves no
    credits. Rows without event id or payment take no part.
    """
    # one shuffle by payment serves the window and both groupings; digests are made behind it
    rows = events.where("event_id IS NOT NULL AND payment IS NOT NULL").repartition("payment").withColumn("digest", digest())
    own = Window.partitionBy("payment", "event_id").orderBy("ts", "digest")
    rows = rows.select("*", (F.row_number().over(own) == 1).alias("once"), (F.col("digest") == F.first("digest").over(own)).alias("same"))
    at = lambda of: F.when(F.col("once") & of, F.struct("ts", "event_id"))
    named = F.col("kind") != "payment"
    rows = rows.select("*", F.when(named, F.col("kind")).alias("what"), F.when(named, F.col("ref")).alias("name"))  # payments make one group
    paid, closed = (at((F.col("kind") == "payment") & is_) for is_ in (F.col("status") == "paid", F.col("status") != "paid"))
    each = rows.groupBy("payment", "what", "name").agg(
        F.max_by(F.struct("status", "amount"), at(named)).alias("last"), F.count_if("once").alias("n"),
        F.min_by(F.struct("order_id", "amount", "credits"), paid).alias("p"), F.max_by(F.struct("order_id", "status"), closed).alias("c"),
        F.count_if(~F.col("once") & F.col("same")).alias("duplicates"), F.count_if(~F.col("same")).alias("conflicts"),
    )
    amount = lambda kind, *states: F.coalesce(F.sum(F.when((F.col("what") == kind) & F.col("last.status").isin(*states), F.col("last.amount"))), F.lit(0))
    all_ = each.groupBy("payment").agg(
        F.first("p", True).alias("p"), F.first("c", True).alias("c"), amount("refund", "succeeded").alias("back"), amount("use", *USED).alias("used"),
        F.count_if((F.col("what") == "refund") & (F.col("n") > 0)).alias("refunds"), F.sum("duplicates").alias("duplicates"), F.sum("conflicts").alias("conflicts"),
    )
    has, whole = F.col("p").isNotNull(), F.col("back") >= F.col("p.amount")
    gone = F.when(whole, F.col("p.credits")).otherwise(F.expr("p.credits * back div nullif(p.amount, 0)"))
    status = F.when(F.col("back") > F.col("p.amount"), "mismatch").when(whole, "refunded").when(F.col("back") > 0, "partially_refunded").otherwise("paid")
    nothing = F.coalesce(F.col("c.status"), F.when(F.col("refunds") > 0, "pending_order").otherwise("pending"))
    zero = lambda c: F.when(has, c).otherwise(F.lit(0)).cast("long")
    return all_.select(
        "payment", F.when(has, F.col("p.order_id")).otherwise(F.col("c.order_id")).alias("order_id"), F.when(has, status).otherwise(nothing).alias("status"),
        zero(F.col("p.amount")).alias("amount"), zero(F.col("back")).alias("refunded"), zero(F.col("p.credits")).alias("credits"), zero(gone).alias("refunded_credits"), F.col("used").cast("long").alias("used"),
        zero(F.greatest(F.lit(0), F.col("p.credits") - gone - F.col("used"))).alias("remaining"), F.when(has, F.lit(0)).otherwise(F.col("back")).cast("long").alias("waiting"), "duplicates", "conflicts",
    )


class OrderState(StatefulProcessor):
    """The state of one payment: recent events by id, refunds and uses by name, and the payment itself.

    An event is kept by its id for ``remember`` milliseconds after the last one came; then a timer drops the ids. What they said stays in the
    other maps; a repetition that comes later is applied again, which changes nothing, but is not counted.
    """

    def __init__(self, remember: int):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "event_id string", "ts long, digest string, same long, other long, kind string, ref string")
        self.named = handle.getMapState("named", "kind string, ref string, event_id string", "ts long, status string, amount long")
        self.pays = handle.getMapState("pays", "event_id string", "ts long, order_id string, status string, amount long, credits long")
        self.counts = handle.getValueState("counts", "duplicates long, conflicts long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self._take(r)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.remember)
        yield self._row(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        duplicates, conflicts = self._counts()
        for _, (_, _, same, other, _, _) in self.events.iterator():
            duplicates, conflicts = duplicates + same, conflicts + other
        self.counts.update((duplicates, conflicts))
        self.events.clear()
        return iter(())

    def _counts(self) -> tuple[int, int]:
        return tuple(self.counts.get()) if self.counts.exists() else (0, 0)

    def _take(self, r: Row) -> None:
        at, key = int(r["us"]), (r["event_id"],)
        if self.events.containsKey(key):
            ts, digest, same, other, kind, ref = self.events.getValue(key)
            if digest == r["digest"]:
                self.events.updateValue(key, (min(ts, at), digest, same + 1, other, kind, ref))
                at = min(ts, at)
            elif (at, r["digest"]) < (ts, digest):  # the earlier content counts from now on: what the later one said goes
                self._drop(kind, ref, r["event_id"])
                self.events.updateValue(key, (at, r["digest"], 0, other + same + 1, r["kind"], r["ref"]))
            else:
                self.events.updateValue(key, (ts, digest, same, other + 1, kind, ref))
                return
        else:
            self.events.updateValue(key, (at, r["digest"], 0, 0, r["kind"], r["ref"]))
        if r["kind"] == "payment":
            self.pays.updateValue(key, (at, r["order_id"], r["status"], r["amount"], r["credits"]))
        else:
            self.named.updateValue((r["kind"], r["ref"], r["event_id"]), (at, r["status"], r["amount"]))

    def _drop(self, kind: str, ref: str, event_id: str) -> None:
        if kind == "payment":
            self.pays.removeKey((event_id,))
        else:
            self.named.removeKey((kind, ref, event_id))

    def _row(self, key) -> Row:
        last: dict[tuple, tuple] = {}
        for (kind, ref, event_id), (ts, status, amount) in self.named.iterator():
            if (kind, ref) not in last or last[kind, ref][:2] < (ts, event_id):
                last[kind, ref] = (ts, event_id, status, amount)
        pays = sorted((ts, event_id, order_id, status, amount, credits) for (event_id,), (ts, order_id, status, amount, credits) in self.pays.iterator())
        paid = next((x[2::2] + (x[5],) for x in pays if x[3] == "paid"), None)
        closed = next((x[2:4] for x in reversed(pays) if x[3] != "paid"), None)
        of = lambda kind: [x[2:] for (k, _), x in last.items() if k == kind]
        duplicates, conflicts = self._counts()
        for _, (_, _, same, other, _, _) in self.events.iterator():
            duplicates, conflicts = duplicates + same, conflicts + other
        out = {"payment": key[0], **_values(paid, closed, of("refund"), of("use")), "duplicates": duplicates, "conflicts": conflicts}
        return Row(**{f.split()[0]: out[f.split()[0]] for f in SETTLED.split(", ")})

    def close(self) -> None:
        pass


def settled_stream(events: DataFrame, remember: int = 7 * 86_400_000) -> DataFrame:
    """SETTLED of each payment that a micro-batch touched, as ``settled`` has it for all events so far.

    No watermark drops anything: a valid payment or refund may come at any time. The session needs ``use_typed_state``.
    """
    rows = events.where("event_id IS NOT NULL AND payment IS NOT NULL").select("*", digest().alias("digest"), F.unix_micros("ts").alias("us"))
    return rows.groupBy("payment").transformWithState(OrderState(remember), SETTLED, "Update", "ProcessingTime")
