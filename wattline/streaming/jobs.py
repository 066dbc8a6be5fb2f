"""Time-dependent operators over append-only events; each takes a batch or a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


QUOTA = "event_id long, key string, ts timestamp, status string, admitted boolean"


def _admit(rows: pd.DataFrame, state: dict, limit: int, seconds: float, budget: int, failures: int) -> list[str]:
    """What becomes of each call, in order; state is updated: times of admitted calls, the request, its calls and its failures in a row."""
    out = []
    for request, ts, failed in zip(rows.request, rows.ts, rows.failed, strict=True):
        if request != state["request"]:
            state |= {"request": request, "calls": 0, "failed": 0}
        t, window = ts.timestamp(), state["times"]
        while window and window[0] <= t - seconds:
            window.pop(0)
        verdict = "budget_exhausted" if state["calls"] >= budget else "circuit_open" if state["failed"] >= failures else "rate_limited" if len(window) >= limit else "admitted"
        if verdict == "admitted":
            window.append(t)
            state["calls"] += 1
            state["failed"] = state["failed"] + 1 if failed else 0
        out.append(verdict)
    return out


def quota_admit(calls: DataFrame, limit: int = 3, seconds: float = 3600.0, budget: int = 1 << 30, failures: int = 1 << 30, delay: str = "1 hour") -> DataFrame:
    """event_id, key, ts, status, admitted of calls (key, request, event_id, ts, failed).

    A call is admitted if its request has fewer than `budget` admitted calls, fewer than `failures` of them failed last in a row, and fewer than
    `limit` admitted calls of the key lie in the `seconds` before it. A key's requests follow one another. The state of a key is
    at most `limit` times and three numbers; a key's calls are judged in order, so one key is one task's work.

    A stream judges in event time: calls wait in the key's state until the watermark, `delay` behind the latest call, has passed them, so it does not matter how
    micro-batches deal them out; those that come later than that are not judged. What waits is at most the calls of a key within the delay.
    """
    rows = calls.select(F.col("key").cast("string").alias("key"), F.col("request").cast("string").alias("request"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "failed")
    fresh = lambda: {"times": [], "request": None, "calls": 0, "failed": 0}

    def judged(frame: pd.DataFrame, state: dict) -> pd.DataFrame:
        status = _admit(frame, state, limit, seconds, budget, failures)
        return pd.DataFrame({"event_id": frame.event_id, "key": frame.key, "ts": frame.ts, "status": status, "admitted": [s == "admitted" for s in status]})

    def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key and time: one key's state is held at a time, whatever the number of its rows."""
        now, state = None, fresh()
        for frame in frames:
            for key, part in frame.groupby("key", sort=False):
                if key != now:
                    now, state = key, fresh()
                yield judged(part, state)

    if not calls.isStreaming:
        return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(in_order, QUOTA)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, waiting = fresh(), []
        if state.exists:
            times, request, count, failed, *columns = state.get
            own = {"times": list(times), "request": request, "calls": count, "failed": failed}
            waiting = list(zip(*columns, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                waiting += list(zip(frame.ts.astype("datetime64[us]").astype("int64").tolist(), frame.event_id.tolist(), frame.request.tolist(), frame.failed.tolist(), strict=True))
        waiting.sort(key=lambda x: x[:2])
        passed = sum(x[0] <= state.getCurrentWatermarkMs() * 1000 for x in waiting)
        if passed:
            ready = pd.DataFrame(waiting[:passed], columns=["ts", "event_id", "request", "failed"])
            yield judged(ready.assign(ts=pd.to_datetime(ready.ts, unit="us"), key=key[0]), own)
        left = waiting[passed:]
        state.update((own["times"], own["request"], own["calls"], own["failed"], *([x[i] for x in left] for i in range(4))))
        if left:
            state.setTimeoutTimestamp(left[0][0] // 1000 + 1)

    kind = "times array<double>, request string, calls long, failed long, wait_ts array<long>, wait_id array<long>, wait_request array<string>, wait_failed array<boolean>"
    return rows.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(step, QUOTA, kind, "append", GroupStateTimeout.EventTimeTimeout)


def provider_calls(events: DataFrame) -> DataFrame:
    """Calls by the given table: a user is a provider, an hour of its events a request, an error a failure."""
    ts = F.col("ts").cast("timestamp")
    return events.select(F.col("user_id").alias("key"), F.date_trunc("hour", ts).cast("string").alias("request"), "event_id", ts.alias("ts"), (F.col("event_type") == "error").alias("failed"))


def leases(events: DataFrame) -> DataFrame:
    """Events of tasks by the given table: a sign-up claims the task, a click is a heartbeat, a purchase ends it."""
    kind = F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "purchase", "done")
    return events.select(F.col("user_id").alias("task_id"), kind.alias("kind"), (F.col("event_id") % 3).alias("worker"), F.col("ts").cast("timestamp").alias("ts"), "event_id").where("kind is not null")


LEASE = "task_id long, last_seen timestamp, attempts long, status string"


def _lease(rows: pd.DataFrame, state: tuple) -> tuple:
    """(holder, seconds of the last claim or heartbeat of the holder, running, claims) after events in order."""
    holder, seen, running, claims = state
    for kind, worker, ts in zip(rows.kind, rows.worker, rows.ts, strict=True):
        if kind == "claim":
            holder, seen, running, claims = int(worker), ts.timestamp(), True, claims + 1
        elif kind == "heartbeat" and worker == holder:
            seen = max(seen, ts.timestamp())
        elif kind == "done":
            running = False
    return holder, seen, running, claims


def lease_expiry(events: DataFrame, as_of: str, lease_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Tasks whose lease has passed: task_id, last_seen, attempts, status (failed). events: task_id, kind, worker, ts, event_id.

    Only a heartbeat of the worker that claimed the task extends its lease. A batch is judged as of a time; a stream by event time: a timer of the
    task's state fires once the watermark passes the end of its lease, and late events beyond `delay` do not count.
    """
    start = (-1, 0.0, False, 0)

    def expired(key: int, state: tuple) -> pd.DataFrame:
        return pd.DataFrame({"task_id": [key], "last_seen": pd.to_datetime([state[1]], unit="s"), "attempts": [state[3]], "status": ["failed"]})

    if not events.isStreaming:
        task = Window.partitionBy("task_id").orderBy("ts", "event_id")
        holder = F.last(F.when(F.col("kind") == "claim", F.col("worker")), ignorenulls=True).over(task)
        rows = events.withColumn("holder", holder)
        counts = (F.col("kind") == "claim") | (F.col("kind") == "heartbeat") & (F.col("worker") == F.col("holder"))
        when = F.struct("ts", "event_id")
        state = rows.groupBy("task_id").agg(F.max(F.when(counts, F.col("ts"))).alias("last_seen"), F.count_if(F.col("kind") == "claim").alias("attempts"), F.max_by("kind", F.when(F.col("kind") != "heartbeat", when)).alias("state"))
        late = F.lit(as_of).cast("timestamp").cast("double") - F.col("last_seen").cast("double") > lease_seconds
        return state.where((F.col("state") == "claim") & late).select(F.col("task_id").cast("long").alias("task_id"), "last_seen", "attempts", F.lit("failed").alias("status"))

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else start
        if state.hasTimedOut:
            state.update((now[0], now[1], False, now[3]))
            yield expired(key[0], now)
            return
        now = _lease(pd.concat(frames).sort_values(["ts", "event_id"]), now)
        if now[2] and (now[1] + lease_seconds) * 1000 <= state.getCurrentWatermarkMs():  # it passed before this event was seen
            state.update((now[0], now[1], False, now[3]))
            yield expired(key[0], now)
            return
        state.update(now)
        if now[2]:
            state.setTimeoutTimestamp(int((now[1] + lease_seconds) * 1000) + 1)

    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy("task_id").applyInPandasWithState(step, LEASE, "holder long, seen double, running boolean, claims long", "append", GroupStateTimeout.EventTimeTimeout)


def idempotent_ingest(events: DataFrame, id_col: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """The first delivery of each id; in a stream among those within the watermark."""
    if events.isStreaming:
        return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark([id_col])
    first = F.row_number().over(Window.partitionBy(id_col).orderBy("ts"))
    return events.withColumn("__wl_n", first).where("__wl_n = 1").drop("__wl_n")
