"""Stateful streaming that puts events in order before it acts on them, by timers at event time.

State with timers needs the RocksDB state store: streams are started with ``events.drained(..., store=ROCKS)`` or inside ``events.stored_by``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADMITTED = "event_id long, user_id long, admitted boolean"


class TokenBucket(StatefulProcessor):
    """A user's events wait until the watermark has passed them, and then take tokens in the order of their times and ids.

    State is the bucket (two numbers) and the events that wait: those of one watermark delay.
    """

    def __init__(self, capacity: float, per_second: float) -> None:
        self.capacity, self.per_second = capacity, per_second

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last long")
        self.waiting = handle.getListState("waiting", "at long, event_id long")

    def wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))  # a timer's milliseconds; times are microseconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [(int(at), int(event)) for batch in rows for at, event in zip(batch["at"], batch["event_id"], strict=True)]
        self.waiting.appendList(found)
        self.wake(min(found)[0])
        yield pd.DataFrame({"event_id": [], "user_id": [], "admitted": []}).astype({"event_id": "int64", "user_id": "int64", "admitted": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r[0], r[1]) for r in self.waiting.get())
        ripe = [r for r in rows if r[0] <= mark]
        tokens, last = self.bucket.get() if self.bucket.exists() else (self.capacity, None)
        out = []
        for at, event in ripe:
            tokens = min(self.capacity, tokens + (0 if last is None else at - last) / 1e6 * self.per_second)
            last = at
            out.append((event, key[0], tokens >= 1))
            tokens -= tokens >= 1
        if ripe:
            self.bucket.update((float(tokens), last))
            if len(ripe) < len(rows):
                self.waiting.put(rows[len(ripe) :])
                self.wake(rows[len(ripe)][0])
            else:
                self.waiting.clear()
        yield pd.DataFrame(out, columns=["event_id", "user_id", "admitted"]).astype({"event_id": "int64", "user_id": "int64", "admitted": "bool"})

    def close(self) -> None:
        pass


def in_order(events: DataFrame, capacity: float = 20.0, per_second: float = 20 / 60, late: str = "1 hour") -> DataFrame:
    """(event_id, user_id, admitted): a token bucket per user, over the events in the order of their times, however batches bring them.

    An event is answered when the watermark reaches it, so batches that are out of order by up to ``late`` are answered as sorted
    ones are; later events are left out, as are events without a time, a user or an id. The last ``late`` of a stream waits for what follows it.
    """
    known = events.where(F.col("ts").isNotNull() & F.col("user_id").isNotNull() & F.col("event_id").isNotNull()).withWatermark("ts", late)
    rows = known.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("user_id").transformWithStateInPandas(TokenBucket(capacity, per_second), ADMITTED, "Append", "EventTime")
