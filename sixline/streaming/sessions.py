"""Streaming forms of the session operators.

Within a batch events are put in order; over batches they count as they arrive, so ticks equal those
of the batch plans where events arrive in their order, and differ for late ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sixline.operators.sessions import md5_axis, packed

_OUT = "user_id long, event_id long, ts timestamp, event_type string, tick long, chaos double, whimsy double, dark double, chaos_m double"
_STATE = "tick long, chaos array<double>, whimsy array<double>"


def _advance(idle_ms: int | None):
    """Tick and momentum of one user's new events: the state holds the tick and the last three raw axes."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tick, chaos, whimsy = state.get if state.exists else (0, [], [])
        chaos, whimsy = list(chaos), list(whimsy)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], ignore_index=True)
        ticks, lifted = [], []
        for c, w in zip(rows["chaos"].tolist(), rows["whimsy"].tolist()):
            tick += 1
            ticks.append(tick)
            lifted.append(min(1.0, c + 0.1 * (sum(chaos) / 3 + sum(whimsy) / 3) / 2) if len(chaos) == 3 else c)
            chaos, whimsy = (chaos + [c])[-3:], (whimsy + [w])[-3:]
        state.update((tick, chaos, whimsy))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield rows.assign(tick=ticks, chaos_m=lifted)[["user_id", "event_id", "ts", "event_type", "tick", "chaos", "whimsy", "dark", "chaos_m"]]

    return advance


def states(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of events as packed states. Late events within a batch are put in order; over batches they come as they arrive.

    With ``idle_ms`` a user's state is dropped after so long without events; such a stream keeps
    running batches without data to look for idle users, so it doesn't end by itself.
    """
    key = F.col("event_id").cast("string")
    raw = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", md5_axis(key, 1).alias("chaos"), md5_axis(key, 3).alias("whimsy"), md5_axis(key, 5).alias("dark"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    moved = raw.groupBy("user_id").applyInPandasWithState(_advance(idle_ms), _OUT, _STATE, "append", timeout)
    return packed(moved)


def observed(stream: DataFrame, *callbacks, **options: str):
    """A started query that hands every batch to each callback; one that fails is passed over and doesn't stop the others or the stream."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for call in callbacks:
                try:
                    call(batch, number)
                except Exception as failed:  # noqa: BLE001
                    print(f"observer {getattr(call, '__name__', call)!s} failed on batch {number}: {failed}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).options(**options).trigger(availableNow=True).start()


def windows(events: DataFrame, late: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """Session windows per user with a watermark; later events are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "events")
