"""Per-user event throttle: pass an event unless it comes too soon after the last one
that passed.  A forced event always passes, and sets the clock as well.

Whether an event passes depends on the event that passed before it, so a user's events
look inherently sequential.  They are still split here, because one user may hold a large
part of all events:

1. A user's time line is cut into chunks, and chunks are spread over the cluster.  If an event
   passes, the next one that does is known: the first that is forced or an interval later.
   These successors are found for all events of many chunks at once, by binary search;
   doubling them gives what every chain of passing events ends with.
2. A chunk is a map from clock to clock: of the time of the last event that passed before it
   to that of the last one in it.  Forced events, and events an interval behind the event
   before them, pass whatever the clock; behind the first of these everything is settled, and
   a chunk with one maps every clock to the same.  Sparse users have little else.
3. Maps compose, and composing is associative: the clocks that chunks start with come from a
   scan over a tree.  Blocks of ``FAN`` chunks are composed to one map each, blocks of blocks
   again, and the clocks go back down.  A task never holds more than ``FAN`` maps of a user at
   once, whatever the length of the time line.
4. With its clock, the unsettled part of a chunk is one chain from one event.

The events themselves are shuffled once, the unsettled ones twice.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from parley.session import stored

# Ship the task functions of this module with the job: executors need not have the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INTERVAL_MS = 15_000
CHUNK_MS = 3_600_000
LEAST_INTERVALS = 3  # a clock must not reach past a whole chunk, so never less than 2
FAN = 64

# Clocks are microseconds; these lie below and above all of them.
LOWEST = -(1 << 62)
HIGHEST = 1 << 62


# ------------------------------------------------------------------ chains

def successors(us: np.ndarray, force: np.ndarray, part: np.ndarray, start: np.ndarray, span: int, interval: int) -> np.ndarray:
    """For events in order, dealt into parts (numbered up) of ``span`` microseconds from ``start``:
    which event of its part passes next if this one does; itself if none."""
    own = np.arange(len(us))
    # All parts on one line, so far apart that no search reaches into the next.
    at = us - start[part] + part * (span + interval + 1)
    late = np.searchsorted(at, at + interval)
    forced = np.append(np.flatnonzero(force), len(us))
    following = np.minimum(late, forced[np.searchsorted(forced[:-1], own, "right")])
    behind = np.searchsorted(part, part, "right")
    return np.where(following < behind, following, own)


def chain_ends(following: np.ndarray) -> np.ndarray:
    """The last event of each event's chain, by doubling."""
    while True:
        further = following[following]
        if (further == following).all():
            return further
        following = further


def on_chains(following: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which events the chains from ``heads`` visit, by doubling."""
    found = np.zeros(len(following), bool)
    found[heads] = True
    while True:
        found[following[found]] = True
        further = following[following]
        if (further == following).all():
            return found
        following = further


# ------------------------------------------------------------------ maps of clocks

Map = tuple[list[int], list[int]]  # bounds, outs: clocks up to bounds[k] become outs[k], later ones stay


def applied(clock: int, bounds: list[int], outs: list[int]) -> int:
    k = bisect_left(bounds, clock)
    return outs[k] if k < len(bounds) else clock


def composed(first: Map, then: Map) -> Map:
    """The map that is ``first``, then ``then``; neighbours with one outcome are one."""
    k = bisect_left(then[0], first[0][-1] + 1) if first[0] else 0
    bounds = [*first[0], *then[0][k:]]
    outs = [*(applied(c, *then) for c in first[1]), *then[1][k:]]
    keep = [i for i in range(len(bounds)) if i + 1 == len(bounds) or outs[i] != outs[i + 1]]
    return [bounds[i] for i in keep], [outs[i] for i in keep]


def _blocks_composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (user, no, maps of one block) to (user, no, map)."""
    for batch in batches:
        found = []
        for maps in batch.column(2).to_pylist():
            whole: Map = ([], [])
            for m in sorted(maps, key=lambda m: m["no"]):
                whole = composed(whole, (m["bounds"], m["outs"]))
            found.append(whole)
        numbers = pa.list_(pa.int64())
        yield pa.record_batch(
            [batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], numbers) for k in (0, 1))],
            ["user_id", "no", "bounds", "outs"])


def _clocks_handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (user, maps of one block, clock it starts with) to (user, no, clock)."""
    for batch in batches:
        row, no, clocks = [], [], []
        for k, (maps, clock) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            clock = LOWEST if clock is None else clock
            for m in sorted(maps, key=lambda m: m["no"]):
                row.append(k)
                no.append(m["no"])
                clocks.append(clock)
                clock = applied(clock, m["bounds"], m["outs"])
        yield pa.record_batch(
            [batch.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int64()), pa.array(clocks, pa.int64())],
            ["user_id", "no", "clock"])


def starting_clocks(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """(user_id, no, clock) of each map (user_id, no, bounds, outs): the clock it starts with.

    Maps of a user follow each other by ``no``; one that is not there changes nothing.
    """
    user = dict(maps.dtypes)["user_id"]
    low, high = maps.agg(F.min("no"), F.max("no")).first()
    height = 1
    while low is not None and (high - low + 1) > fan**height:
        height += 1
    # Blocks start at the lowest number, so that a block is never cut by its level's end.
    levels = [maps.withColumn("no", F.col("no") - F.lit(low or 0).cast("long"))]
    parent = F.floor(F.col("no") / fan).cast("long").alias("block")
    members = F.collect_list(F.struct("no", "bounds", "outs")).alias("maps")
    for _ in range(height - 1):
        blocks = levels[-1].groupBy("user_id", parent).agg(members).select("user_id", F.col("block").alias("no"), "maps")
        schema = f"user_id {user}, no long, bounds array<long>, outs array<long>"
        levels.append(stored(blocks.mapInArrow(_blocks_composed, schema), "throttle-blocks"))
    clocks = None
    for level in reversed(levels):
        blocks = level.groupBy("user_id", parent).agg(members)
        if clocks is None:
            blocks = blocks.withColumn("clock", F.lit(None).cast("long"))
        else:
            blocks = blocks.join(clocks.withColumnRenamed("no", "block"), ["user_id", "block"])
        clocks = blocks.select("user_id", "maps", "clock").mapInArrow(
            _clocks_handed_down, f"user_id {user}, no long, clock long")
    return clocks.withColumn("no", F.col("no") + F.lit(low or 0).cast("long"))


# ------------------------------------------------------------------ events

def _settled(interval: int, length: int):
    """Chunks (user, no, events in order) to events that pass whatever the clock, and for
    chunks where it matters, or that hand one on, their map and their unsettled events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            events = lists.flatten()
            us = pc.struct_field(events, "us").to_numpy(zero_copy_only=False)
            force = pc.struct_field(events, "force").to_numpy(zero_copy_only=False).astype(bool)
            ident = pc.struct_field(events, "event_id")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("i8")
            part = np.repeat(np.arange(len(sizes)), sizes)
            start = batch.column(1).to_numpy(zero_copy_only=False) * length
            behind = np.cumsum(sizes)
            first = behind - sizes
            following = successors(us, force, part, start, length, interval)
            last = chain_ends(following)

            before = np.append(LOWEST, us[:-1])
            before[first] = start  # whatever passed before the chunk did so before it starts
            sure = np.append(np.flatnonzero(force | (us - before >= interval)), len(us))
            settled = np.minimum(sure[np.searchsorted(sure, first)], behind)
            holds = settled < behind
            passed = np.flatnonzero(on_chains(following, settled[holds])) if holds.any() else np.zeros(0, "i8")
            none = pa.nulls(len(passed), pa.list_(pa.int64()))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(part[passed])), pa.nulls(len(passed), pa.int64()), none, none,
                 pa.nulls(len(passed), pa.list_(ident.type)), none, ident.take(pa.array(passed)),
                 pa.array(us[passed]), pa.array(force[passed])], _NAMES)

            ends = np.where(holds, us[last[np.minimum(settled, len(us) - 1)]], HIGHEST)
            # Only a clock in the last interval of its chunk matters to the next one.
            kept = np.flatnonzero((settled > first) | (ends > start + length - interval))
            bounds, outs, edges = [], [], [0]
            for k in kept.tolist():
                if holds[k]:
                    bounds.append([HIGHEST])
                    outs.append([int(ends[k])])
                else:
                    out = us[last[first[k]:behind[k]]]
                    turn = np.flatnonzero(np.append(out[1:] != out[:-1], True))
                    bounds.append((us[first[k] + turn] - interval).tolist())
                    outs.append(out[turn].tolist())
            open_ = np.repeat(first[kept], (settled - first)[kept])
            edges = np.append(0, np.cumsum((settled - first)[kept])).astype("i4")
            open_ += np.arange(len(open_)) - np.repeat(edges[:-1], np.diff(edges))
            numbers, n = pa.list_(pa.int64()), len(kept)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)),
                 pa.array(bounds, numbers), pa.array(outs, numbers),
                 pa.ListArray.from_arrays(pa.array(edges), ident.take(pa.array(open_))),
                 pa.ListArray.from_arrays(pa.array(edges), pa.array(us[open_])),
                 pa.nulls(n, ident.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], _NAMES)

    return run


_NAMES = ["user_id", "no", "bounds", "outs", "ids", "times", "event_id", "us", "force"]


def _unsettled(interval: int, length: int):
    """Chunks (user, no, ids, times, clock) to the events that pass with that clock."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            us = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            ident = batch.column(2).flatten()
            sizes = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False).astype("i8")
            part = np.repeat(np.arange(len(sizes)), sizes)
            start = batch.column(1).to_numpy(zero_copy_only=False) * length
            following = successors(us, np.zeros(len(us), bool), part, start, length, interval)
            clock = np.maximum(batch.column(4).to_numpy(zero_copy_only=False), start - interval)
            span = length + interval + 1
            at = us - start[part] + part * span
            head = np.searchsorted(at, clock + interval - start + np.arange(len(sizes)) * span)
            head = head[head < np.cumsum(sizes)]
            passed = np.flatnonzero(on_chains(following, head))
            yield pa.record_batch(
                [ident.take(pa.array(passed)), batch.column(0).take(pa.array(part[passed])), pa.array(us[passed]),
                 pa.array(np.zeros(len(passed), bool))], ["event_id", "user_id", "us", "force"])

    return run


def throttle_events(
    events: DataFrame,
    interval_ms: int = INTERVAL_MS,
    intervals_per_chunk: int | None = None,
    fan: int = FAN,
) -> DataFrame:
    """The events (event_id, user_id, ts, force) that pass, one clock per user.

    An event exactly ``interval_ms`` after the last one passes.  Events of one user at the
    same time are taken in ``event_id`` order.  A chunk is an hour, or a few intervals when
    those are longer: short enough to spread one user.  Events without a user are nobody's
    and do not pass.
    """
    interval = interval_ms * 1000
    length = interval * max(2, intervals_per_chunk or max(LEAST_INTERVALS, -(-CHUNK_MS // interval_ms)))
    types = dict(events.dtypes)
    user, ident = types["user_id"], types["event_id"]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    narrow = events.where(F.col("user_id").isNotNull()).select(
        "user_id", "event_id", us.alias("us"), F.coalesce("force", F.lit(False)).alias("force"))
    chunks = narrow.groupBy("user_id", F.floor(F.col("us") / length).alias("no")).agg(
        F.array_sort(F.collect_list(F.struct("us", "event_id", "force"))).alias("events"))
    # Stored, since maps, unsettled events and passed ones are used apart.
    followed = stored(chunks.mapInArrow(
        _settled(interval, length),
        f"user_id {user}, no long, bounds array<long>, outs array<long>, ids array<{ident}>, times array<long>, "
        f"event_id {ident}, us long, force boolean"), "throttle-chunks")
    maps = followed.where("no IS NOT NULL").select("user_id", "no", "bounds", "outs")
    unsettled = followed.where("no IS NOT NULL AND size(times) > 0").select("user_id", "no", "ids", "times").join(
        starting_clocks(maps, fan), ["user_id", "no"])
    late = unsettled.mapInArrow(_unsettled(interval, length), f"event_id {ident}, user_id {user}, us long, force boolean")
    passed = followed.where("no IS NULL").select("event_id", "user_id", "us", "force").unionByName(late)
    return passed.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), "force")
