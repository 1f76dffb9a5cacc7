"""Incremental saving of messages.

Each micro-batch is checked against the sessions and written, with its outcome, to a
folder of its own; replaying a batch after a failure writes the same folder again.  A
message is never saved twice: of rows with one id, in one batch or in several, the first
that can be saved is (within a batch by ``created_at``), and those behind it are not answered
again.

What a batch costs does not grow with what was saved before.  Saved ids lie in hash
buckets with Bloom filters, and a batch reads the buckets its own ids fall into; sessions
written with ``write_sessions`` are looked up the same way.  Touching sessions and refreshing
profiles is not done row by row on the big tables: every batch adds a small change set,
change sets and ids are folded (``tiers``), and the current tables are read as the snapshot
with the few that are left folded in.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.changes import _as_column, touch_sessions, upsert_profiles
from parley.operators.ingest import INCOMPLETE, SAVED, UNAUTHORIZED, classify_messages
from parley.operators.sessions import last_activity
from parley.plans.buckets import few_keys, hit_buckets, read_hit, write_buckets
from parley.schemas import CHAT_SESSIONS, INCOMING_MESSAGES
from parley.sources.tables import read_or_empty, read_table
from parley.streaming.tiers import Table, Tiers

_WRITERS = "id long, email string, created_at timestamp, message_id long, batch_id long"


def _latest_writers(rows: DataFrame) -> DataFrame:
    rest = ["email", "created_at", "message_id", "batch_id"]
    last = F.max_by(F.struct(*rest), F.struct("batch_id", "created_at", "message_id"))
    return rows.groupBy("id").agg(last.alias("last")).select("id", "last.*")


def _latest_activity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.max("last_at").alias("last_at"))


def _plain(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def change_sets(spark: SparkSession, out: str) -> Tiers:
    """What the batches below ``out`` add: saved ids, sessions' activity, writers."""
    return Tiers(spark, out, {
        "ids": Table("id long", lambda rows: rows, lambda rows, path: write_buckets(rows, path, "id", "overwrite")),
        "activity": Table("session_id long, last_at timestamp", _latest_activity, _plain),
        "writers": Table(_WRITERS, _latest_writers, _plain),
    })


def write_sessions(sessions: DataFrame, path: str) -> None:
    """A sessions snapshot that batches can look single sessions up in."""
    write_buckets(sessions, path, "id")


def read_sessions(spark: SparkSession, path: str, hit: list[int] | None = None) -> DataFrame:
    """A sessions snapshot; only the buckets in ``hit`` if it lies in buckets."""
    try:
        in_buckets = hit is not None and "bucket" in spark.read.parquet(path).columns
    except AnalysisException:
        in_buckets = False  # a snapshot without rows has no files to tell
    if in_buckets:
        return read_hit(spark, _ddl(CHAT_SESSIONS), path, [path], hit)
    return read_table(spark, path, "chat_sessions")


def earlier_ids(spark: SparkSession, out: str, batch_id: int, arrived: DataFrame, hit: list[int]) -> DataFrame:
    """Of the ids that ``arrived`` may hold, those saved before the batch: from the buckets in
    ``hit`` alone, and for few ids from the row groups that may hold them."""
    tiers = change_sets(spark, out)
    held = read_hit(spark, "id long", f"{out}/ids", tiers.paths("ids", tiers.runs(batch_id)), hit)
    few = few_keys(arrived, "id")
    return held if few is None else held.where(F.col("id").isin(few))


def save_batch(batch: DataFrame, batch_id: int, sessions_path: str, out: str, now) -> None:
    """Write one micro-batch: all rows by status, then the change sets they imply."""
    spark = batch.sparkSession
    folder = f"{out}/requests/batch_id={batch_id}"
    # The source is read once; everything below reads the stored batch.
    stamped = batch.withColumns({"created_at": F.coalesce("created_at", _as_column(now)), "place": F.monotonically_increasing_id()})
    stamped.write.mode("overwrite").parquet(f"{out}/arrived")
    arrived = spark.read.schema(f"{_ddl(INCOMING_MESSAGES)}, place long").parquet(f"{out}/arrived")
    hit_ids, hit_sessions = hit_buckets(arrived, "id", "session_id")

    fresh = arrived.join(earlier_ids(spark, out, batch_id, arrived, hit_ids), "id", "left_anti")
    classified = classify_messages(fresh.select(*arrived.columns), read_sessions(spark, sessions_path, hit_sessions))
    order = F.struct("created_at", F.xxhash64(*batch.columns), "place")
    repeated = classified.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("status") == SAVED[0], order)).alias("first")
    ).where("n > 1 AND first IS NOT NULL").select("id", "first")
    repeated.write.mode("overwrite").parquet(f"{out}/repeated")
    repeated = spark.read.schema(repeated.schema).parquet(f"{out}/repeated")
    answered = classified.join(repeated, "id", "left").where(F.col("first").isNull() | (order <= F.col("first")))
    answered.select(*batch.columns, "status", "reason").write.partitionBy("status").mode("overwrite").parquet(folder)

    # From here on the written rows are read.
    written = spark.read.schema(f"{_ddl(INCOMING_MESSAGES)}, reason string, status int").parquet(folder)
    saved = written.where(F.col("status") == SAVED[0])
    complete = written.where(~F.col("status").isin(UNAUTHORIZED[0], INCOMPLETE[0]))
    change_sets(spark, out).commit(batch_id, {
        "ids": saved.where(F.col("id").isNotNull()).select("id"),
        "activity": last_activity(saved),
        "writers": complete.select(
            F.col("user_id").alias("id"), "email", "created_at", F.col("id").alias("message_id"),
            F.lit(batch_id).cast("long").alias("batch_id")),
    })


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def ingest_stream(
    messages: DataFrame, sessions_path: str, out: str, checkpoint: str, now=None, **trigger
) -> StreamingQuery:
    """Start saving a stream of ``schemas.INCOMING_MESSAGES`` rows below ``out``.

    ``out`` and ``checkpoint`` must lie on storage every executor shares.
    """
    now = F.current_timestamp() if now is None else now

    def save(batch: DataFrame, batch_id: int) -> None:
        save_batch(batch, batch_id, sessions_path, out, now)

    return (
        messages.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def requests_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Everything ingested, with ``status`` and ``reason``."""
    schema = f"{_ddl(INCOMING_MESSAGES)}, reason string, batch_id long, status int"
    return read_or_empty(spark, schema, f"{out}/requests")


def saved_messages(spark: SparkSession, out: str) -> DataFrame:
    """The message table; the status is a folder name, so only saved rows are read."""
    saved = requests_so_far(spark, out).where(F.col("status") == SAVED[0])
    return saved.select("id", "session_id", "user_id", "role", "content", "created_at")


def current_sessions(spark: SparkSession, sessions_path: str, out: str) -> DataFrame:
    return touch_sessions(read_sessions(spark, sessions_path), change_sets(spark, out).read("activity"))


def current_profiles(spark: SparkSession, profiles_path: str, out: str, now) -> DataFrame:
    changes = change_sets(spark, out).read("writers").select("id", "email")
    return upsert_profiles(read_table(spark, profiles_path, "profiles"), changes, now)
