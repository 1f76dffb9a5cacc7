"""The throttle against a plain walk through the events."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parley import schemas
from parley.operators.throttle import (
    LOWEST, applied, chain_ends, composed, on_chains, successors, throttle_events,
)

BASE = dt.datetime(2024, 1, 1)


def walk(events, interval):
    """Ids that pass, one event after the other; ``events`` are (time, id, force)."""
    clock, passed = None, []
    for at, ident, force in sorted(events):
        if force or clock is None or at - clock >= interval:
            passed.append(ident)
            clock = at
    return passed


def _map_of(events, interval):
    """A chunk's map by walking it with every clock that may make a difference."""
    bounds = sorted({at - interval for at, _, _ in events})
    outs = []
    for clock in bounds:
        for at, _, force in sorted(events):
            if force or at - clock >= interval:
                clock = at
        outs.append(clock)
    return bounds, outs


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 200), st.booleans() | st.just(False)), max_size=60),
    st.integers(1, 20), st.integers(2, 5),
)
def test_maps_compose_to_a_walk(points, interval, per_chunk):
    events = sorted((at, i, force) for i, (at, force) in enumerate(points) if not force)
    length = interval * per_chunk
    whole = ([], [])
    for start in sorted({at // length * length for at, _, _ in events}):
        whole = composed(whole, _map_of([e for e in events if e[0] // length * length == start], interval))
    for clock in (LOWEST, -interval, -1, 5):
        last = clock
        for at, _, _ in events:
            if at - last >= interval:
                last = at
        if clock < 0:
            assert applied(clock, *whole) == last


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 120), st.integers(0, 2), st.booleans() | st.just(False)), min_size=1, max_size=80),
    st.integers(1, 20),
)
def test_chains_follow_the_next_event_that_passes(points, interval):
    points = sorted(points, key=lambda p: (p[1], p[0]))
    us, part, force = (np.array([p[k] for p in points]) for k in range(3))
    _, part = np.unique(part, return_inverse=True)
    following = successors(us, force.astype(bool), part, np.zeros(part.max() + 1, "i8"), 121, interval)
    for i, p in enumerate(points):
        want = next((j for j in range(i + 1, len(points))
                     if part[j] == part[i] and (points[j][2] or points[j][0] - p[0] >= interval)), i)
        assert following[i] == want
    head = int(np.flatnonzero(part == 0)[0])
    walked = [head]
    while following[walked[-1]] != walked[-1]:
        walked.append(int(following[walked[-1]]))
    assert np.flatnonzero(on_chains(following, np.array([head]))).tolist() == walked
    assert chain_ends(following)[head] == walked[-1]


def frame(spark, rows):
    stamped = [(i, u, BASE + dt.timedelta(milliseconds=ms), f) for i, u, ms, f in rows]
    return spark.createDataFrame(stamped, schemas.REFRESH_EVENTS)


def test_limits(spark):
    rows = [
        (1, 1, 0, False), (2, 1, 14_999, False), (3, 1, 15_000, False), (4, 1, 16_000, True), (5, 1, 30_999, False),
        (6, 1, 31_000, False), (7, 2, 100, None), (8, 2, 100, False),
    ]
    got = throttle_events(frame(spark, rows))
    assert sorted(r.event_id for r in got.collect()) == [1, 3, 4, 6, 7]
    assert got.columns == schemas.REFRESH_EVENTS.names


@pytest.mark.parametrize("fan", [2, 64])
@pytest.mark.parametrize("per_chunk", [2, 3, 8, None])
def test_dense_users(spark, per_chunk, fan):
    """Also over a tree of several levels: a block of two maps at a time."""
    rng = random.Random(per_chunk or 0)
    rows = [
        # User 0 has most of the events, several per interval over many chunks.
        (i, 0 if rng.random() < 0.7 else rng.randrange(1, 5), rng.randrange(0, 2_000_000), rng.random() < 0.01)
        for i in range(4000)
    ]
    want = set()
    for user in range(5):
        want.update(walk([(ms, i, f) for i, u, ms, f in rows if u == user], 15_000))
    got = throttle_events(frame(spark, rows), 15_000, per_chunk, fan)
    assert sorted(r.event_id for r in got.collect()) == sorted(want)


def test_events_without_a_user_do_not_pass(spark):
    rows = frame(spark, [(1, 1, 0, False), (2, 2, 0, True)])
    rows = rows.withColumn("user_id", F.when(F.col("user_id") == 1, F.col("user_id")))
    assert [r.event_id for r in throttle_events(rows).collect()] == [1]
    assert throttle_events(rows.where("user_id IS NULL")).count() == 0


def test_a_user_spans_tasks(spark):
    """Events and maps are shuffled by user and stretch of time, never by user alone."""
    df = throttle_events(frame(spark, [(i, 1, i * 1000, False) for i in range(2000)]), 15_000, 2)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan
    assert not re.search(r"hashpartitioning\(user_id#\w+, \d+\)", plan)


def test_users_with_text_ids(spark):
    rows = frame(spark, [(1, 1, 0, False), (2, 1, 10, False), (3, 2, 10, False)])
    text = rows.withColumn("user_id", F.concat(F.lit("u"), "user_id")).withColumn("event_id", F.concat(F.lit("e"), "event_id"))
    assert sorted(r.event_id for r in throttle_events(text).collect()) == ["e1", "e3"]
