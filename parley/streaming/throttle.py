"""The event throttle over a stream, in two forms.

``throttle_stream`` runs the batch throttle on every micro-batch, so it shares a hot user's
events among tasks.  What has to be remembered is written with the batch: events the
watermark has not passed yet, and clocks recent enough to hold an event back.

``keyed_throttle`` keeps its state in the state store.  It has no tables of its own.
Every access to the store is a call to another process, so users share a state by a hash of
their id, and calls go by buckets of time and not by events.  What a batch adds to a bucket
is written beside what lies there, and a bucket is read and gone through when the watermark
has passed its end, so no batch touches more of the waiting events than it adds or lets go.
A user's events go through one task.

In both, events wait until the watermark has passed them and are then taken in time order,
whatever order they arrived in; events behind the watermark are dropped and reported.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parley.operators.throttle import INTERVAL_MS, throttle_events
from parley.sources.tables import read_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENTS = "event_id long, user_id long, ts timestamp, force boolean"


def throttle_batch(
    batch: DataFrame, batch_id: int, out: str, interval_ms: int, delay_ms: int, last: bool = False
) -> None:
    """One micro-batch.  Everything goes to folders named by the batch, and only the
    folders of the batch before are read, so a replay writes the same again.

    With ``last`` nothing is waited for any more.
    """
    spark = batch.sparkSession

    def before(table: str, schema: str) -> DataFrame:
        return read_or_empty(spark, schema, f"{out}/{table}/batch_id={batch_id - 1}")

    def write(df: DataFrame, table: str) -> str:
        path = f"{out}/{table}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return path

    us = F.unix_micros("ts")
    mark = before("progress", "watermark long").first()
    old = mark.watermark if mark else None
    # The source is read once; everything below reads the stored batch.
    stored = write(batch.select("event_id", "user_id", "ts", "force"), "arrived")
    arrived = spark.read.schema(EVENTS).parquet(stored)
    known = arrived.unionByName(before("waiting", EVENTS)) if last else arrived
    newest = known.agg(F.max(us)).first()[0]
    if old is None and newest is None:
        return
    seen = [] if newest is None else [newest - (0 if last else delay_ms * 1000)]
    watermark = max(seen + ([] if old is None else [old]))

    is_late = F.lit(False) if old is None else us <= old
    write(arrived.where(is_late), "late")
    known = arrived.where(~is_late).unionByName(before("waiting", EVENTS))
    write(known.where(us > watermark), "waiting")

    # A clock of an earlier batch is an event that has passed already: it passes again and
    # is left out of the result.
    clocks = before("clocks", "user_id long, ts timestamp")
    passed_before = clocks.withColumns({"event_id": F.lit(None).cast("long"), "force": F.lit(True)})
    passed = throttle_events(known.where(us <= watermark).unionByName(passed_before), interval_ms)
    path = write(passed.where(F.col("event_id").isNotNull()), "passed")

    latest = spark.read.schema(EVENTS).parquet(path).select("user_id", "ts").unionByName(clocks)
    recent = latest.groupBy("user_id").agg(F.max("ts").alias("ts")).where(us > watermark - interval_ms * 1000)
    write(recent, "clocks")
    write(spark.range(1).select(F.lit(watermark).cast("long").alias("watermark")), "progress")


def finish(spark: SparkSession, out: str, interval_ms: int = INTERVAL_MS) -> None:
    """After the stream's end: the events that still wait are taken as they are."""
    batches = read_or_empty(spark, "watermark long, batch_id long", f"{out}/progress")
    latest = batches.agg(F.max("batch_id")).first()[0]
    if latest is not None:
        none = spark.createDataFrame([], EVENTS)
        throttle_batch(none, latest + 1, out, interval_ms, 0, last=True)


def throttle_stream(
    events: DataFrame, out: str, checkpoint: str, interval_ms: int = INTERVAL_MS, delay_ms: int = 60_000, **trigger
) -> StreamingQuery:
    """Start throttling a stream of (event_id, user_id, ts, force) into folders below ``out``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        throttle_batch(batch, batch_id, out, interval_ms, delay_ms)

    return (
        events.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def passed_events(spark: SparkSession, out: str) -> DataFrame:
    return read_or_empty(spark, f"{EVENTS}, batch_id long", f"{out}/passed")


def waiting_events(spark: SparkSession, out: str) -> DataFrame:
    """Events that the last batch left waiting for the watermark."""
    waiting = read_or_empty(spark, f"{EVENTS}, batch_id long", f"{out}/waiting")
    latest = read_or_empty(spark, "watermark long, batch_id long", f"{out}/progress").agg(F.max("batch_id")).scalar()
    return waiting.where(F.col("batch_id") == latest)


def late_events(spark: SparkSession, out: str) -> DataFrame:
    return read_or_empty(spark, f"{EVENTS}, batch_id long", f"{out}/late")


STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch saves what it changed, and not the files of the whole store.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_state_store(spark: SparkSession) -> None:
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


SHARDS = 256
WAITING = np.dtype([("user_id", "<i8"), ("us", "<i8"), ("event_id", "<i8"), ("force", "?")])
CLOCKS = np.dtype([("user_id", "<i8"), ("us", "<i8")])
OPEN = np.dtype([("bucket", "<i8"), ("pieces", "<i8")])
OUT_ROWS = 10_000


class Throttle(StatefulProcessor):
    """The clocks of a shard's users, and the events that wait for the watermark, packed in
    pieces: one for every bucket of time and frame of rows.

    A shard has one timer, at the end of its first bucket.  A clock is kept no longer than it
    can hold an event back, one that waits included: without a bucket the timer is where the
    last clock ends, since the store's own expiry counts processing time.
    """

    def __init__(self, interval_us: int, bucket_us: int):
        self.interval, self.bucket = interval_us, bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clocks = handle.getValueState("clocks", "clocks binary")
        self.open = handle.getValueState("open", "buckets binary, wake long")
        self.waiting = handle.getMapState("waiting", "bucket long, piece long", "events binary")

    def _opened(self) -> tuple[dict[int, int], int | None]:
        """The number of pieces of every bucket that has some, and the timer."""
        held = self.open.get()
        if held is None:
            return {}, None
        return dict(np.frombuffer(held[0], OPEN).tolist()), held[1]

    def _set(self, buckets: dict[int, int], wake: int | None, us: int) -> None:
        """Keep ``buckets``, and wake at ``us`` instead of ``wake``."""
        at = -(-us // 1000)
        if at != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(at)
        self.open.update((np.array(list(buckets.items()), OPEN).tobytes(), at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buckets, wake = self._opened()
        for frame in rows:
            arrived = np.zeros(len(frame), WAITING)
            for name in WAITING.names:
                # Fails for a NULL, which has become a NaN.
                arrived[name] = frame[name].astype(WAITING[name])
            own = arrived["us"] // self.bucket
            order = np.argsort(own, kind="stable")
            turns = np.flatnonzero(np.diff(own[order])) + 1
            for piece in np.split(arrived[order], turns):
                bucket = int(piece["us"][0]) // self.bucket
                self.waiting.updateValue((bucket, buckets.get(bucket, 0)), (piece.tobytes(),))
                buckets[bucket] = buckets.get(bucket, 0) + 1
        self._set(buckets, wake, (min(buckets) + 1) * self.bucket)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All input of a batch is handled before its timers: nothing at or before the
        # watermark can still arrive.
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        buckets, _ = self._opened()
        held = self.clocks.get()
        clocks = dict(np.frombuffer(held[0], CLOCKS).tolist()) if held else {}
        passed, n = [], 0
        for bucket in sorted(b for b in buckets if (b + 1) * self.bucket <= mark):
            names = [(bucket, piece) for piece in range(buckets.pop(bucket))]
            events = np.concatenate([np.frombuffer(self.waiting.getValue(name)[0], WAITING) for name in names])
            events = events[np.lexsort((events["force"], events["event_id"], events["us"]))]
            kept = []
            for k, (user, us, _, force) in enumerate(events.tolist()):
                if force or user not in clocks or us - clocks[user] >= self.interval:
                    clocks[user] = us
                    kept.append(k)
            for name in names:
                self.waiting.removeKey(name)
            passed.append(events[kept])
            n += len(kept)
            if n >= OUT_ROWS:
                yield pd.DataFrame(np.concatenate(passed))
                passed, n = [], 0
        if n:
            yield pd.DataFrame(np.concatenate(passed))

        left = min([mark, *(b * self.bucket for b in buckets)])
        clocks = {user: us for user, us in clocks.items() if us + self.interval > left}
        if clocks:
            self.clocks.update((np.array(list(clocks.items()), CLOCKS).tobytes(),))
        elif held:
            self.clocks.clear()
        if buckets or clocks:
            self._set(buckets, None, (min(buckets) + 1) * self.bucket if buckets else max(clocks.values()) + self.interval)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def keyed_throttle(
    events: DataFrame, interval_ms: int = INTERVAL_MS, delay: str = "1 minute", bucket_ms: int = 60_000, shards: int = SHARDS
) -> DataFrame:
    """The passing events of a stream (event_id, user_id, ts, force), in append mode.

    Events come out when the watermark has passed their bucket of ``bucket_ms``.  ``shards``
    states are shared by all users; the number has to stay as long as the checkpoint is used.
    """
    use_state_store(events.sparkSession)
    narrow = events.where(F.col("user_id").isNotNull()).withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("user_id"), F.lit(shards)).cast("int").alias("shard"),
        "user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("force", F.lit(False)).alias("force"),
    )
    passed = narrow.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=Throttle(interval_ms * 1000, bucket_ms * 1000),
        outputStructType="user_id long, us long, event_id long, force boolean",
        outputMode="append",
        timeMode="eventTime",
    )
    return passed.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), "force")
