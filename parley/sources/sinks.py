"""Writers.  Each triggers a job.

Plain Parquet has no row updates, so a changed table is a new snapshot in a new folder
and appended rows are new files.  A folder being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.text import stored_title


def append_messages(accepted: DataFrame, path: str) -> DataFrame:
    """Append rows that passed ``operators.ingest``; returns the inserted rows."""
    accepted.write.mode("append").parquet(path)
    return accepted


def write_clustered(messages: DataFrame, path: str, row_group_bytes: int = 16 << 20) -> None:
    """The message table in order of user, session and time, for look-ups of one conversation.

    Rows are range-partitioned, so a hot user or session spreads over files; a look-up reads
    the row groups whose bounds, or Bloom filter of the sessions, allow its key, and finds
    them in order already.
    """
    order = ["user_id", "session_id", "created_at", "id"]
    (
        messages.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.bloom.filter.enabled#session_id", "true")
        .option("parquet.bloom.filter.expected.ndv#session_id", "100000")
        .parquet(path)
    )


def id_from(key) -> Column:
    """A UUID-shaped id that is the same whenever the same key is seen again.

    A random id would change when a lost task is run again or a frame is read twice.
    """
    digest = F.md5(F.col(key).cast("string"))
    return F.regexp_replace(digest, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")


def new_sessions(requests: DataFrame, now, key: str = "request_id") -> DataFrame:
    """Rows for newly opened sessions (user_id, title, key): default title, id by ``key``."""
    return requests.select(
        id_from(key).alias("id"),
        "user_id",
        stored_title("title").alias("title"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def append_sessions(sessions: DataFrame, path: str) -> DataFrame:
    """Append new sessions; returns the inserted rows."""
    sessions.write.mode("append").parquet(path)
    return sessions


def write_snapshot(table: DataFrame, path: str) -> None:
    """Write a table's next snapshot to a folder that must not exist yet."""
    table.write.mode("errorifexists").parquet(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """One JSON document per line: the body of each model request."""
    requests.select(F.col("body").alias("value")).write.mode("errorifexists").text(path)
