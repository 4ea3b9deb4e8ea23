"""Structured Streaming forms of the reducers, equal to the batch ones on the same events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_state(events: DataFrame) -> DataFrame:
    """Running latest event of each user by ``event_id``; output mode update or complete."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("x")).select("user_id", "x.*")


def lease_sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions closed by a pause, with a watermark for late events; output mode append."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = stamped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("session_end"))
    return by.select("user_id", F.col("w.start").alias("session_start"), "session_end", "n")


def counters(events: DataFrame) -> DataFrame:
    """Counts by type from signed deltas; a retraction is an event of value -1."""
    return events.groupBy("event_type").agg(F.sum(F.when(F.col("value") < 0, -1).otherwise(1)).alias("n"))


def _reduce(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    high, kept, dropped = state.get if state.exists else (-1, 0, 0)
    for seq in sorted(s for frame in frames for s in frame["seq"].tolist()):
        if seq > high:
            high, kept = seq, kept + 1
        else:
            dropped += 1
    state.update((high, kept, dropped))
    yield pd.DataFrame([(key[0], high, kept, dropped)], columns=["user_id", "high", "kept", "dropped"])


def progress(events: DataFrame) -> DataFrame:
    """Per user the highest sequence number, events kept and late or repeated ones dropped; state is three numbers a key.

    ``events(user_id, seq)``; within a micro-batch events are taken in the order of ``seq``.
    """
    schema = "user_id long, high long, kept long, dropped long"
    return events.groupBy("user_id").applyInPandasWithState(_reduce, schema, "high long, kept long, dropped long", "update", GroupStateTimeout.NoTimeout)


def once(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each operation key, for as long as the watermark remembers it; output mode append."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def guarded(events: DataFrame, legal: dict[str, tuple[str, ...]]) -> DataFrame:
    """``events(user_id, seq, state)`` with ``before`` and ``legal``; state is the last one of each key; output mode append.

    Within a micro-batch events are taken in the order of ``seq``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = sorted((s, t) for f in frames for s, t in zip(f["seq"].tolist(), f["state"].tolist(), strict=True))
        out = []
        for seq, now in rows:
            out.append((key[0], seq, now, before, before is None or now in legal.get(before, ())))
            before = now
        if before is not None:
            state.update((before,))
        yield pd.DataFrame(out, columns=["user_id", "seq", "state", "before", "legal"])

    schema = "user_id long, seq long, state string, before string, legal boolean"
    return events.groupBy("user_id").applyInPandasWithState(step, schema, "before string", "append", GroupStateTimeout.NoTimeout)


def interrupted(events: DataFrame, terminal: list[str], idle: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``events(user_id, ts, state)``: each key's terminal state, or INTERRUPTED once the watermark is ``idle`` past its last event.

    State is the time of the last event; output mode append.
    """
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["user_id", "state"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "INTERRUPTED")], columns=names)
            return
        last, ended = state.get[0] if state.exists else 0, None
        for f in frames:
            for ts, now in zip(f["ts"], f["state"], strict=True):
                last = max(last, int(ts.timestamp() * 1000))
                ended = now if now in terminal else ended
        if ended is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], ended)], columns=names)
        else:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + pause, state.getCurrentWatermarkMs() + 1))

    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy("user_id").applyInPandasWithState(step, "user_id long, state string", "last long", "append", GroupStateTimeout.EventTimeTimeout)
