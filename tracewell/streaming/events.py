"""Structured Streaming over event tables: windows, sessions, deduplication, rate limits, upserts.

Each operator is a function of a streaming (or batch) DataFrame. ``drained`` runs one over a folder of
Parquet files until all input is read, into a table of the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


STORE = "spark.sql.streaming.stateStore.providerClass"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; event times as timestamps."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def stored_by(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """Streams that start inside keep their state in a store of this class, where one is named."""
    before = spark.conf.get(STORE, None)
    if provider:
        spark.conf.set(STORE, provider)
    try:
        yield
    finally:
        if provider:
            spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def drained(stream: DataFrame, mode: str = "append", store: str | None = None) -> DataFrame:
    """All rows that the stream yields from what is there now, exactly once, as a table; its state in a store of class ``store``."""
    with stored_by(stream.sparkSession, store):
        return _drained(stream, mode)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/tracewell-stream/{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    else:  # complete results replace each other

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{where}/out")

        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def windowed(events: DataFrame, size: str, late: str) -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are left out."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """A user's sessions: runs of events with no gap as long as ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first of events that repeat the keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, capacity: float = 20.0, per_second: float = 20 / 60) -> DataFrame:
    """Token bucket per user: each event takes a token if there is one; buckets refill steadily.

    State is two numbers per user. Works on streams; event times must not run backwards between batches (``ordered.in_order`` takes those that do).
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts in zip(rows["event_id"], rows["ts"], strict=True):
            now = ts.timestamp()
            tokens = min(capacity, tokens + max(0.0, now - (last if last is not None else now)) * per_second)
            last = now
            ok = tokens >= 1
            tokens -= ok
            out.append((event_id, key[0], bool(ok)))
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "admitted"])

    return events.groupBy("user_id").applyInPandasWithState(admit, "event_id long, user_id long, admitted boolean", "tokens double, last double", "append", "NoTimeout")


def upsert(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """base with rows of fresh put in place of those that share its key (for ``foreachBatch``)."""
    return base.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def changed_only(stored: DataFrame, found: DataFrame, key: str, stamps: list[str]) -> DataFrame:
    """Rows of found whose stamps are not stored as they are: the ones to process again."""
    return found.join(stored.select(key, *stamps), [key, *stamps], "left_anti")


def run(query: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str, mode: str = "append", store: str | None = None) -> DataFrame:
    return drained(query(source(spark, sf_dir, "events")), mode, store)
