import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from parley import schemas
from parley.operators import ingest, prompts, throttle
from parley.plans import registry
from parley.plans.fixtures import Tables, now
from parley.sources import sinks
from parley.sources.tables import stream_table
from parley.streaming import messages, responses, tiers, throttle as streams

FOLDER = "/root/testdata/sf0.001"
BASE = dt.datetime(2024, 1, 1)


def differences(a, b):
    columns = sorted(a.columns)
    return a.select(columns).exceptAll(b.select(columns)).count() + b.select(columns).exceptAll(a.select(columns)).count()


def test_ingest_equals_batch_across_restarts_and_replays(spark, tmp_path):
    t = Tables(spark, FOLDER)
    source, out, check = (str(tmp_path / n) for n in ("incoming", "out", "check"))
    base, people = str(tmp_path / "sessions"), str(tmp_path / "profiles")
    sinks.write_snapshot(t.sessions(), base)
    sinks.write_snapshot(t.profiles(), people)
    parts = t.incoming().randomSplit([0.5, 0.5], seed=1)

    for part in parts:
        part.repartition(2).write.mode("append").parquet(source)
        stream = stream_table(spark, source, "incoming_messages", maxFilesPerTrigger=1)
        messages.ingest_stream(stream, base, out, check, now=now()).awaitTermination()

    want = ingest.ingest_messages(t.incoming(), t.sessions(), t.profiles(), now())
    assert messages.requests_so_far(spark, out).select("batch_id").distinct().count() > 2
    assert differences(messages.saved_messages(spark, out), want.accepted) == 0
    assert differences(messages.current_sessions(spark, base, out), want.sessions) == 0
    assert differences(
        messages.requests_so_far(spark, out).where("status <> 200").select("id", "status", "reason"),
        want.rejected.select("id", "status", "reason"),
    ) == 0
    profiles = messages.current_profiles(spark, people, out, now())
    assert differences(profiles.select("id"), want.profiles.select("id")) == 0

    # The last batch once more, as after a failure between writing and committing.
    last = messages.requests_so_far(spark, out).agg(F.max("batch_id")).first()[0]
    batch = messages.requests_so_far(spark, out).where(F.col("batch_id") == last).select(schemas.INCOMING_MESSAGES.names)
    rows = spark.createDataFrame(batch.collect(), schemas.INCOMING_MESSAGES)
    messages.save_batch(rows, last, base, out, now())
    assert differences(messages.saved_messages(spark, out), want.accepted) == 0


def test_nothing_ingested_yet(spark, tmp_path):
    t, base = Tables(spark, FOLDER), str(tmp_path / "sessions")
    sinks.write_snapshot(t.sessions(), base)
    assert messages.saved_messages(spark, str(tmp_path / "out")).count() == 0
    assert differences(messages.current_sessions(spark, base, str(tmp_path / "out")), t.sessions()) == 0


def _incoming(spark, rows):
    """Messages (id, content, second of the day) of user 1 to session 1."""
    stamped = [(i, 1, 1, "a@x.org", "user", c, None if s is None else BASE + dt.timedelta(seconds=s)) for i, c, s in rows]
    return spark.createDataFrame(stamped, schemas.INCOMING_MESSAGES)


def _one_session(spark, path):
    row = [(1, 1, "t", BASE, BASE)]
    messages.write_sessions(spark.createDataFrame(row, schemas.CHAT_SESSIONS), path)


def test_a_message_sent_twice_at_once_is_saved_once(spark, tmp_path):
    base, out = str(tmp_path / "sessions"), str(tmp_path / "out")
    _one_session(spark, base)
    rows = [(5, "later", 9), (5, "first", 3), (5, "", 1), (6, "same", 4), (6, "same", 4), (None, "a", 1), (None, "a", 1)]
    messages.save_batch(_incoming(spark, rows), 0, base, out, now())
    messages.save_batch(_incoming(spark, [(5, "once more", 20), (7, "new", 21)]), 1, base, out, now())
    saved = sorted((r.id or 0, r.content) for r in messages.saved_messages(spark, out).collect())
    assert saved == [(0, "a"), (0, "a"), (5, "first"), (6, "same"), (7, "new")]
    # The first of id 5 could not be saved, and is answered; what came behind the saved one is not.
    assert messages.requests_so_far(spark, out).where("id = 5").count() == 2


def test_a_batch_reads_only_the_buckets_it_hits(spark, tmp_path):
    base, out = str(tmp_path / "sessions"), str(tmp_path / "out")
    _one_session(spark, base)
    folders = []
    for batch in range(8):
        ids = range(100 * batch, 100 * batch + 100)
        messages.save_batch(_incoming(spark, [(i, f"m{i}", i) for i in ids]), batch, base, out, now())
        folders.append(sum(len(list((tmp_path / "out" / name).iterdir())) for name in ("ids", "activity", "writers", "manifest")))
    assert max(folders[4:]) <= max(folders[:4]) + 3
    last = _incoming(spark, [(3, "again", 1000), (99_999, "new", 1001)])
    hit = set(messages.hit_buckets(last, "id")[0])
    # Files of all other buckets are damaged: a look-up that opened one would fail.
    for file in (tmp_path / "out" / "ids").glob("*/bucket=*/*.parquet"):
        if int(file.parent.name.split("=")[1]) not in hit:
            file.write_bytes(b"no Parquet")
    messages.save_batch(last, 8, base, out, now())
    assert {r.id for r in messages.saved_messages(spark, out).collect()} >= {3, 99_999}
    assert messages.saved_messages(spark, out).where("id = 3").count() == 1
    assert messages.saved_messages(spark, out).count() == 801


def test_tiers_stay_few_and_are_found_again_on_replay(spark, tmp_path):
    out = str(tmp_path / "out")
    table = tiers.Table("k long, n long", lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")),
                        lambda rows, path: rows.write.mode("overwrite").parquet(path))
    store = tiers.Tiers(spark, out, {"sums": table})
    assert store.read("sums").count() == 0
    for batch in range(22):
        rows = spark.createDataFrame([(batch % 3, 1)], "k long, n long")
        for _ in range(2 if batch % 5 == 3 else 1):
            store.commit(batch, {"sums": rows})
    assert sorted((r.k, r.n) for r in store.read("sums").collect()) == [(0, 8), (1, 7), (2, 7)]
    assert len(store.runs()) <= (tiers.FANOUT - 1) * tiers.LEVELS
    assert len(list((tmp_path / "out" / "manifest").glob("*.json"))) == 2


def test_pairing_equals_batch_with_disorder_restart_and_time_out(spark, tmp_path):
    rng = random.Random(11)
    asked, heard = [], []
    for i in range(60):
        sent = i * 120
        files = [("image", "a.png", None, "data:x")] if i % 3 == 0 else []
        asked.append((i, "" if i % 17 == 0 else f"question {i}", files, sent))
        for attempt in ("primary", "fallback"):
            for _ in range(rng.choice([0, 1, 1, 2])):
                body = rng.choice(['{"choices":[{"message":{"content":"%d"}}]}' % rng.randrange(99), '{"error":{"message":"down"}}'])
                heard.append((i, attempt, body, sent + rng.choice([1, 30, 200, 299, 300, 301, 900])))

    def frames(requests, answers):
        at = lambda s: BASE + dt.timedelta(seconds=s)
        return (spark.createDataFrame([(*r[:3], at(r[3])) for r in requests], schemas.SENT_REQUESTS),
                spark.createDataFrame([(*r[:3], at(r[3])) for r in answers], schemas.RECEIVED_RESPONSES))

    paths = [str(tmp_path / n) for n in ("requests", "answers", "out", "check")]

    def arrive(requests, answers):
        for frame, path in zip(frames(requests, answers), paths):
            frame.repartition(2).write.mode("append").parquet(path)
        sources = [stream_table(spark, p, n) for p, n in zip(paths, ("sent_requests", "received_responses"))]
        responses.resolve_stream(*sources, *paths[2:], timeout="5 minutes", delay="10 minutes").awaitTermination()
        return responses.outcomes_so_far(spark, paths[2])

    # By time, but for ten minutes of disorder.
    late = lambda r: r[3] + rng.randrange(600)
    mixed = sorted([("r", r, late(r)) for r in asked] + [("a", a, late(a)) for a in heard], key=lambda x: x[2])
    for k in range(3):
        part = mixed[k * len(mixed) // 3:(k + 1) * len(mixed) // 3]
        arrive([r for kind, r, _ in part if kind == "r"], [a for kind, a, _ in part if kind == "a"])
    # What comes much later lets the last ones time out.
    for later in (90_000, 180_000):
        got = arrive([(-later, "later", [], later)], [(-later - 1, "primary", "{}", later)])
    got = got.where("request_id >= 0")

    requests, answers = frames(asked, heard)
    in_time = answers.join(requests.select("request_id", "sent_at"), "request_id").where(
        "received_at <= sent_at + INTERVAL 5 MINUTES").select(answers.columns)
    want = prompts.resolve_responses(requests, in_time)
    assert differences(got, want) == 0
    assert {r.outcome for r in got.collect()} == {"answer", "error", "fallback", "pending"}


def test_the_requests_of_all_arrivals_are_derived_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    class Counted(Tables):
        def raw(self, name):
            rows = super().raw(name)
            return rows.withColumn("text", counted.asNondeterministic()("text")) if name == "documents" else rows

    t, folders = Counted(spark, FOLDER), []
    run_folder = registry.run_folder
    monkeypatch.setattr(registry, "run_folder", lambda *a: folders.append(run_folder(*a)) or folders[-1])
    got = responses.outcomes_so_far(spark, registry._paired_stream(t)).where("request_id >= 0")
    assert got.count() == registry._outgoing(Tables(spark, FOLDER)).count()
    assert seen.value == Tables(spark, FOLDER).raw("documents").count()
    # A batch saves its changes to the state.
    assert list(pathlib.Path(folders[0], "checkpoint", "state").rglob("*.changelog"))


def write_events(spark, source, rows):
    events_of(spark, rows).coalesce(1).write.mode("append").parquet(source)


def events_of(spark, rows):
    stamped = [(i, u, BASE + dt.timedelta(milliseconds=ms), f) for i, u, ms, f in rows]
    return spark.createDataFrame(stamped, schemas.REFRESH_EVENTS)


def keyed(spark, source, out, check, bucket_ms=7_000):
    stream = stream_table(spark, source, "refresh_events", maxFilesPerTrigger=1)
    query = (
        streams.keyed_throttle(stream, 15_000, "10 seconds", bucket_ms).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", check).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    dropped = [op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]]
    return spark.read.parquet(out), sum(dropped)


def batched(spark, source, out, check):
    stream = stream_table(spark, source, "refresh_events", maxFilesPerTrigger=1)
    streams.throttle_stream(stream, out, check, 15_000, 10_000).awaitTermination()
    return streams.passed_events(spark, out), streams.late_events(spark, out).count()


def keyed_wide(spark, source, out, check):
    """Buckets wider than the interval: a clock outlives its interval while events wait."""
    return keyed(spark, source, out, check, 60_000)


@pytest.mark.parametrize("run", [keyed, keyed_wide, batched])
def test_throttle_equals_batch_with_disorder_restart_and_late_events(spark, tmp_path, run):
    rng = random.Random(3)
    paths = [str(tmp_path / n) for n in ("events", "out", "check")]
    rows = [(i, rng.randrange(3), rng.randrange(i * 2000, i * 2000 + 8000), rng.random() < 0.05) for i in range(150)]
    write_events(spark, paths[0], rows[:50])
    write_events(spark, paths[0], rows[50:100])
    run(spark, *paths)
    write_events(spark, paths[0], rows[100:])
    # Far ahead: moves the watermark past everything.
    write_events(spark, paths[0], [(901, 9, 10_000_000, False)])
    run(spark, *paths)
    # Long after the watermark: dropped.
    write_events(spark, paths[0], [(902, 0, 20, True), (903, 9, 20_000_000, False)])
    passed, dropped = run(spark, *paths)

    want = throttle.throttle_events(events_of(spark, rows))
    got = {r.event_id for r in passed.collect()}
    assert got - {901, 903} == {r.event_id for r in want.collect()}
    assert dropped == 1


def test_keyed_throttle_calls_the_store_for_buckets_and_not_for_events(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("events", "out", "check"))
    rows = [(i, i % 3000, i % 40_000 + i // 3000, i % 11 == 0) for i in range(6000)]
    calls = []
    for part in (rows, [(9000, 9000, 10_000_000, False)]):
        write_events(spark, source, part)
        stream = stream_table(spark, source, "refresh_events")
        query = (
            streams.keyed_throttle(stream, 15_000, "10 seconds", 60_000).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", check).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        calls += [op["numRowsUpdated"] + op["numRowsRemoved"] for p in query.recentProgress for op in p["stateOperators"]]
    want = throttle.throttle_events(events_of(spark, rows))
    got = spark.read.schema(streams.EVENTS).parquet(out).where("user_id < 9000")
    assert differences(got.select("event_id", "user_id", "ts", "force"), want) == 0
    # One bucket: its events, the list of buckets, the clocks and the timer of every shard.
    assert 0 < max(calls) < 3000


def test_a_replayed_throttle_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(i, i % 2, i * 4000, False) for i in range(40)]
    first, second = events_of(spark, rows[:20]), events_of(spark, rows[20:])
    # An empty batch hands on what the one before has left.
    for batch, number in ((first.limit(0), 0), (first, 1), (first.limit(0), 2), (second, 3), (second, 3)):
        streams.throttle_batch(batch, number, out, 15_000, 0)
    want = throttle.throttle_events(events_of(spark, rows))
    assert differences(streams.passed_events(spark, out).select("event_id"), want.select("event_id")) == 0


def test_arrivals_keep_their_partitions_and_are_a_batch_each(spark, tmp_path):
    events = Tables(spark, FOLDER).refresh_events().repartition(3)
    path, out, files = str(tmp_path / "events"), str(tmp_path / "out"), [0]
    for _ in registry._arrivals(events, path, "ts"):
        files.append(len(list((tmp_path / "events").glob("*.parquet"))))
        stream = stream_table(spark, path, "refresh_events")
        streams.throttle_stream(stream, out, str(tmp_path / "check"), 1000, delay_ms=3_600_000).awaitTermination()
    assert [b - a for a, b in zip(files, files[1:])] == [3] * 4
    assert spark.read.schema(schemas.TABLES["refresh_events"]).parquet(path).count() == events.count()
    assert streams.late_events(spark, out).count() == 0
    assert spark.read.parquet(f"{out}/progress").select("batch_id").distinct().count() == 4
