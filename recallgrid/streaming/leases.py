"""Claims with leases, back-off and dead letters as a stateful stream with timers.

A log of requests (group_id, ts, event) drives one small state for each work item; what a request changes, and what
time changes, comes out as rows (group_id, ts, state, attempts, until). Each item's state is a status, a number of
attempts and a time, kept with those of the items of its bucket; nothing grows with the log.

Events: add (once, makes an item pending), claim (of a pending item, or of a failed one whose back-off is over: in
progress until the lease ends, one attempt more), success (ends it), failed (waits 30 s, doubled for each attempt
before; with the last attempt the item is dead), limited (a rate limit: waits as long, but never kills), fatal (dead at
once), release (pending again). A claim adds an unknown item. Requests that don't fit an item's state are passed over,
as are results of work that isn't in progress. A lease that ends makes the item pending again, and so does a back-off
that ends; timers see to both, and a request that is later than the end finds it done.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds of a lease and of the first back-off, and how often an item is tried.
LEASE_SECONDS, BACKOFF, ATTEMPTS = 3600, 30, 3
PENDING, RUNNING, FAILED, DEAD, DONE = "pending", "in_progress", "failed", "dead_letter", "success"

#: How many states items are dealt into.
BUCKETS = 4096
#: status, attempts, and when a lease or a back-off ends, in ms since 1970 (0: nothing to wait for).
State = tuple[str, int, int]
_NONE = np.datetime64("NaT", "ms")


def ended(state: State, now: int) -> State | None:
    """The state after a lease or a back-off that is over by now; None while it goes on."""
    status, attempts, until = state
    return (PENDING, attempts, 0) if until and until <= now else None


def step(state: State | None, event: str, now: int, lease: int = LEASE_SECONDS, most: int = ATTEMPTS) -> State | None:
    """The state after a request, None if it doesn't fit."""
    if state is None:
        if event == "add":
            return PENDING, 0, 0
        state = (PENDING, 0, 0)
    status, attempts, _ = state
    if event == "claim" and status == PENDING:
        return RUNNING, attempts + 1, now + 1000 * lease
    if status != RUNNING:
        return None
    if event == "success":
        return DONE, attempts, 0
    if event == "fatal" or (event == "failed" and attempts >= most):
        return DEAD, attempts, 0
    if event in ("failed", "limited"):
        return FAILED, attempts, now + 1000 * BACKOFF * 2 ** max(0, attempts - 1)
    return (PENDING, attempts, 0) if event == "release" else None


def advance(batches: Iterator[pd.DataFrame], held, lease: int, most: int, by_event: bool) -> Iterator[pd.DataFrame]:
    """The changes of a bucket's items, from their requests or from the end of leases and back-offs; the first end is its timer."""
    now = held.getCurrentWatermarkMs() if by_event else held.getCurrentProcessingTimeMs()
    states: dict = {}
    if held.exists:
        states = {item: (status, attempts, until) for item, status, attempts, until in zip(*held.get)}
    out: list[tuple] = []
    for item, state in states.items():
        if over := ended(state, now):
            out.append((item, state[2], *over))
            states[item] = over
    log = [] if held.hasTimedOut else [r for b in batches for r in zip(b["ms"].tolist(), b["event"].tolist(), b["group_id"].tolist())]
    log.sort(key=lambda r: (r[0], r[1] is None, r[1] or ""))
    for at, event, item in log:
        state = states.get(item)
        if state and (over := ended(state, at)):
            out.append((item, state[2], *over))
            states[item] = state = over
        if new := step(state, event, at, lease, most):
            out.append((item, at, *new))
            states[item] = new
    if out:
        status, attempts, until = zip(*states.values())
        held.update((list(states), list(status), list(attempts), list(until)))
    if first := min((s[2] for s in states.values() if s[2]), default=0):  # a call forgets the timer; a watermark past it fires it
        if by_event:
            held.setTimeoutTimestamp(max(first - 1, now + 1))
        else:
            held.setTimeoutDuration(max(1, first - now))
    if out:
        item, ts, status, attempts, until = zip(*out)
        times = lambda ms: np.array([t if t else _NONE for t in ms], "datetime64[ms]").astype("datetime64[ns]")
        yield pd.DataFrame({"group_id": item, "ts": times(ts), "state": status, "attempts": attempts, "until": times(until)})


def leases(log: DataFrame, lease: int = LEASE_SECONDS, most: int = ATTEMPTS, late: str = "10 minutes", time_mode: str = "EventTime", buckets: int = BUCKETS) -> DataFrame:
    """(group_id, ts, state, attempts, until) of every change, from a stream (group_id, ts, event), in output mode append.

    In EventTime, time is the watermark (the latest ts less late); later requests are dropped, and timers fire as it
    passes; a run gives the same rows whatever its micro-batches, up to leases and back-offs that it hasn't reached.
    In ProcessingTime timers fire by the clock, whether requests come or not. Items are dealt into buckets by hash, each
    of which is one state and one timer, as a call of Python takes milliseconds and a request microseconds; a stream
    keeps the number it began with. With many items the state store should be RocksDB (`with_rocksdb`).
    """
    kind = dict(log.dtypes)["group_id"]
    timed = log.select("group_id", F.col("ts").cast("timestamp").alias("ts"), "event").withWatermark("ts", late)
    rows = timed.withColumns({"ms": F.unix_millis("ts"), "bucket": F.pmod(F.xxhash64("group_id"), F.lit(buckets))})
    by_event = time_mode == "EventTime"

    def changes(key, batches, held):
        return advance(batches, held, lease, most, by_event)

    # Without an event-time column the output is append's own; rows carry their time as ts.
    shape = f"group_id {kind}, ts timestamp, state string, attempts int, until timestamp"
    state = f"items array<{kind}>, status array<string>, attempts array<int>, until array<long>"
    return rows.groupBy("bucket").applyInPandasWithState(changes, shape, state, "append", f"{time_mode}Timeout")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark, run):
    """run() while the session's state store is RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def milliseconds(t: datetime) -> int:
    return round(t.replace(tzinfo=timezone.utc).timestamp() * 1000)
