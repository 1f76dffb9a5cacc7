"""Saving messages in bulk, and building profiles from sign-ups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F, types as T

from parley.functions.text import age_strict, empty_to_null, falsy, stored_title
from parley.operators.changes import _as_column, touch_sessions, update_titles, upsert_profiles
from parley.operators.quality import ROLES

# Status and message of each outcome, in the order they are decided.
UNAUTHORIZED = (401, "Unauthorized")
INCOMPLETE = (400, "Session ID, Role, and Content are required")
NOT_FOUND = (404, "Session not found")
BAD_ROLE = (500, "Failed to save message")
SAVED = (200, None)
NOT_SAVED = (500, "Failed to create session")
SESSION_REQUIRED = (400, "Session ID is required")


class Ingested(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame
    sessions: DataFrame
    profiles: DataFrame


def early_status():
    """What can be decided from the request alone; NULL when the session must be looked up."""
    return (
        F.when(falsy("user_id"), UNAUTHORIZED[0])
        .when(falsy("session_id") | falsy("role") | falsy("content"), INCOMPLETE[0])
    )


def owned(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages whose session exists and belongs to their writer."""
    keys = sessions.select(F.col("id").alias("session_id"), "user_id")
    return messages.join(keys, ["session_id", "user_id"], "left_semi").select(*messages.columns)


def not_owned(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """The other messages: "Session not found"."""
    keys = sessions.select(F.col("id").alias("session_id"), "user_id")
    return messages.join(keys, ["session_id", "user_id"], "left_anti").select(*messages.columns)


def classify_messages(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every message with its ``status`` and ``reason``.

    The one join is a plain left join on the session key with nothing on top that needs
    the same partitioning, so AQE can split a hot session's partition.
    """
    owned = sessions.select(F.col("id").alias("session_id"), "user_id", F.lit(True).alias("owned"))
    status = F.coalesce(
        early_status(),
        F.when(F.col("owned").isNull(), NOT_FOUND[0]),
        F.when(~F.col("role").isin(ROLES), BAD_ROLE[0]),
        F.lit(SAVED[0]),
    )
    reason = F.lit(None).cast("string")
    for code, message in (UNAUTHORIZED, INCOMPLETE, NOT_FOUND, BAD_ROLE):
        reason = F.when(F.col("status") == code, F.lit(message)).otherwise(reason)
    return (
        messages.join(owned, ["session_id", "user_id"], "left")
        .withColumn("status", status)
        .withColumn("reason", reason)
        .drop("owned")
        .select(*messages.columns, "status", "reason")
    )


def session_activity(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, last_at): latest message each session would accept.

    Messages are reduced per (session, writer) before they meet the sessions, so what is
    shuffled is one row per session and task however many messages a session has.
    """
    latest = (
        messages.where(early_status().isNull() & F.col("role").isin(ROLES))
        .groupBy("session_id", "user_id")
        .agg(F.max("created_at").alias("last_at"))
    )
    owners = sessions.select(F.col("id").alias("session_id"), "user_id")
    return latest.join(owners, ["session_id", "user_id"], "left_semi").select("session_id", "last_at")


def writers(messages: DataFrame) -> DataFrame:
    """(id, email) of everybody whose request was complete, whether or not it was saved.

    The profile is refreshed before the session is looked up.
    """
    return (
        messages.where(early_status().isNull())
        .groupBy("user_id")
        .agg(F.max_by("email", F.struct("created_at", "id")).alias("email"))
        .select(F.col("user_id").alias("id"), "email")
    )


def ingest_messages(messages: DataFrame, sessions: DataFrame, profiles: DataFrame, now) -> Ingested:
    """Save a batch of messages.

    ``accepted`` are rows for the message table; ``rejected`` carry status and reason;
    ``sessions`` and ``profiles`` are the next snapshots (session activity moved forward,
    writers' profiles created or refreshed).
    """
    now = _as_column(now)
    stamped = messages.withColumn("created_at", F.coalesce("created_at", now))
    classified = classify_messages(stamped, sessions)
    accepted = classified.where(F.col("status") == SAVED[0]).select(
        "id", "session_id", "user_id", "role", "content", "created_at"
    )
    return Ingested(
        accepted,
        classified.where(F.col("status") != SAVED[0]),
        touch_sessions(sessions, session_activity(stamped, sessions)),
        upsert_profiles(profiles, writers(stamped), now),
    )


class SavedSessions(NamedTuple):
    sessions: DataFrame
    returned: DataFrame
    rejected: DataFrame
    profiles: DataFrame


def save_sessions(requests: DataFrame, sessions: DataFrame, profiles: DataFrame, now, new_id) -> SavedSessions:
    """Open new sessions, or retitle the one a request names.

    ``requests(request_id, user_id, email, title, update_id)``, counted in ``request_id``
    order.  ``new_id`` is the id Column of a new session; it must come out the same when a
    request is read again (``sources.sinks.id_from``).  A session opened in the batch can be
    retitled in the same batch.  Every signed-in writer's profile is created or refreshed.
    ``returned`` answers every request that was carried out with its session as that
    request left it: the session's columns and ``request_id``.
    """
    now = _as_column(now)
    signed = requests.where(~falsy("user_id"))
    opened = signed.where(falsy("update_id")).select(
        new_id.alias("id"), "user_id", stored_title("title").alias("title"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    retitled = signed.where(~falsy("update_id")).select(
        F.col("update_id").alias("id"), "user_id", "title", "request_id"
    )
    after, _, unmatched = update_titles(sessions.unionByName(opened), retitled, now, ["request_id"])
    rejected = requests.where(falsy("user_id")).select(
        "request_id", F.lit(UNAUTHORIZED[0]).alias("status"), F.lit(UNAUTHORIZED[1]).alias("reason")
    ).unionByName(
        unmatched.select(
            "request_id", F.lit(NOT_SAVED[0]).alias("status"), F.lit(NOT_SAVED[1]).alias("reason")
        )
    )
    refreshed = upsert_profiles(
        profiles, signed.select(F.col("user_id").alias("id"), "email", "request_id"), now, ["request_id"]
    )
    every = sessions.unionByName(opened)
    answered = retitled.select("id", "user_id", "request_id", stored_title("title").alias("new_title")).join(
        every, ["id", "user_id"])
    left = {"title": F.col("new_title"), "updated_at": now}
    returned = answered.select(
        "request_id", *[left.get(c, F.col(c)).alias(c) for c in sessions.columns]
    ).unionByName(signed.where(falsy("update_id")).select("request_id", new_id.alias("id")).join(opened, "id").select(
        "request_id", *sessions.columns))
    return SavedSessions(after, returned, rejected, refreshed)


def check_deletes(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete requests (request_id, user_id, session_id) as (keys to delete, rejected).

    A key that matches nothing is not an error.
    """
    status = F.when(falsy("user_id"), UNAUTHORIZED[0]).when(falsy("session_id"), SESSION_REQUIRED[0])
    reason = F.when(falsy("user_id"), UNAUTHORIZED[1]).otherwise(F.lit(SESSION_REQUIRED[1]))
    checked = requests.withColumn("status", status)
    keys = checked.where("status IS NULL").select(F.col("session_id").alias("id"), "user_id")
    return keys, checked.where("status IS NOT NULL").select("request_id", "status", reason.alias("reason"))


METADATA = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("first_name", "last_name", "age", "gender", "grade_year")
])


def build_profiles(signups: DataFrame, now) -> DataFrame:
    """Profiles from sign-up metadata: empty text is NULL, a non-numeric age is NULL."""
    now = _as_column(now)
    # One parse per row; values that are not strings (an age as a number) come as text.
    given = signups.select("id", "email", F.from_json("user_metadata", METADATA).alias("m"))
    return given.select(
        "id",
        "email",
        empty_to_null("m.first_name").alias("first_name"),
        empty_to_null("m.last_name").alias("last_name"),
        age_strict("m.age").alias("age"),
        empty_to_null("m.gender").alias("gender"),
        empty_to_null("m.grade_year").alias("grade_year"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
