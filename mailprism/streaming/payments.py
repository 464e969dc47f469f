"""Subscriptions kept by a stream of payment events: one state value per user in the state store, with a timer for its expiry."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailprism.operators.accounts import CHARGE_DAYS

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000  # microseconds
LATE = 3650  # days that an event may be behind the newest one
STATE = "subscription_id string, tier string, billing_cycle string, activated_at long, last_charge long, cancelled boolean, expired boolean"
NAMES = [c.split(" ")[0] for c in STATE.split(", ")]
ACTIVATED, CHARGED, CANCELLED = "subscription.activated", "subscription.charged", "subscription.cancelled"


def folded(state: tuple | None, events: list[tuple]) -> tuple:
    """State after events (time, event_id, event, subscription_id, tier, billing_cycle) in any order.

    The last activation starts a new subscription; charges and cancellations after it count if they name it, and charges
    only until its first cancellation. Without an activation the current subscription goes on, or that of the first event begins.
    """
    events = sorted(events, key=lambda e: e[:2])
    at = max((k for k, e in enumerate(events) if e[2] == ACTIVATED), default=None)
    if at is not None:
        time, _, _, sub, tier, cycle = events[at]
        state, events = (sub, tier, cycle, time, None, False, False), events[at + 1:]
    elif state is None:
        state = (events[0][3], None, None, None, None, False, False)
    sub, tier, cycle, activated, charge, cancelled, expired = state
    for time, _, event, name, _, _ in events:
        if name is None or name != sub or cancelled:
            continue
        if event == CANCELLED:
            cancelled = True
        elif event == CHARGED:
            charge, expired = time, False
    return sub, tier, cycle, activated, charge, cancelled, expired


def expiry(state: tuple) -> int | None:
    """When the paid time of a subscription ends, in microseconds."""
    _, _, cycle, activated, charge, _, _ = state
    since = activated if charge is None else charge
    return None if since is None else since + CHARGE_DAYS["annual" if cycle == "annual" else "monthly"] * DAY


class Subscriptions(StatefulProcessor):
    """Folds a user's events of a micro-batch into the user's state and emits the new state; other users are not touched.

    The events that one user has in one micro-batch are held for ordering, those before the last activation seen so far excepted.
    The clock is the newest event time of the batches before. When it passes the end of a user's paid time, a timer emits the
    state once more with ``expired`` set. As the watermark stays ``late`` days behind that clock, so that late events count,
    the timer is set as many days earlier.
    """

    def __init__(self, key: str, late: int):
        self.key, self.late = key, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("subscription", STATE)

    def row(self, key, state: tuple) -> Row:
        return Row(**{self.key: key[0], **dict(zip(NAMES, state))})

    def keep(self, key, state: tuple) -> Iterator[Row]:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        end = expiry(state)
        if end is not None and not state[-1]:
            self.handle.registerTimer((end - self.late * DAY) // 1000)
        self.state.update(state)
        yield self.row(key, state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, since = [], None
        for r in rows:
            event = (r.event_time, r.event_id, r.event, r.subscription_id, r.tier, r.billing_cycle)
            if since is not None and event[:2] < since:
                continue
            held.append(event)
            if r.event == ACTIVATED:
                since = event[:2]
                held = [e for e in held if e[:2] >= since]
        before = self.state.get() if self.state.exists() else None
        yield from self.keep(key, folded(tuple(before) if before else None, held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = (*tuple(self.state.get())[:-1], True)
        self.state.update(state)
        yield self.row(key, state)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        state = tuple(initialState[c] for c in NAMES)
        self.state.update(state)

    def close(self) -> None:
        pass


def as_state(users: DataFrame, key: str = "user_id") -> DataFrame:
    """Users with the subscription they start with (subscription_id, tier, billing_cycle) as first states."""
    none = F.lit(None).cast("long")
    return users.select(key, "subscription_id", "tier", "billing_cycle", none.alias("activated_at"), none.alias("last_charge"),
                        F.lit(False).alias("cancelled"), F.lit(False).alias("expired"))


def with_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in ("activated_at", "last_charge")})


def subscription_stream(events: DataFrame, key: str = "user_id", start: DataFrame | None = None, late: int = LATE) -> DataFrame:
    """Changed subscriptions of each micro-batch. ``events``: key, event_time, event_id, event, subscription_id, tier, billing_cycle;
    ``start``: states by key before the first event (``as_state``)."""
    rows = events.where(F.col("event").isin(ACTIVATED, CHARGED, CANCELLED))
    rows = rows.withColumn("clock", F.col("event_time")).withWatermark("clock", f"{late} days")
    rows = rows.select(key, "clock", F.unix_micros("event_time").alias("event_time"), "event_id", "event", "subscription_id", "tier", "billing_cycle")
    kind = dict(rows.dtypes)[key]
    first = start.groupBy(key) if start is not None else None
    return with_times(rows.groupBy(key).transformWithState(Subscriptions(key, late), f"{key} {kind}, {STATE}", "Update", "EventTime", first))


def payment_state(spark: SparkSession, events: DataFrame, path: str, key: str = "user_id", start: DataFrame | None = None) -> DataFrame:
    """Run the stream over what is available and return all current subscriptions.

    A micro-batch reads and writes the state of its own users only; their new rows go to ``<path>/changes/batch=<n>`` (a
    retried batch overwrites its folder). All subscriptions are read from the state store, not added up from the changes.
    """
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        out = subscription_stream(events, key, start).writeStream.outputMode("update").foreachBatch(write)
        out.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return current_subscriptions(spark, path, key)
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def current_subscriptions(spark: SparkSession, path: str, key: str = "user_id") -> DataFrame:
    """State of every user after the last micro-batch, read from the state store."""
    rows = spark.read.format("statestore").option("stateVarName", "subscription").load(f"{path}/checkpoint")
    return with_times(rows.select(F.col(f"key.{key}").alias(key), "value.*"))
