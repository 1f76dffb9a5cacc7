"""Session listings, last activity, message counts and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.functions.text import date_text, datetime_text, shorten_title, shown_title, title_base
from parley.operators.access import visible


def last_activity(messages: DataFrame) -> DataFrame:
    """(session_id, last_at)."""
    return messages.groupBy("session_id").agg(F.max("created_at").alias("last_at"))


def message_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, n_messages, is_empty) of every session, empty ones included."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return sessions.select(F.col("id").alias("session_id")).join(counts, "session_id", "left").select(
        "session_id", n.alias("n_messages"), (n == 0).alias("is_empty")
    )


def list_sessions(sessions: DataFrame, uid) -> DataFrame:
    """Visible sessions with their display columns, most recent first.

    ``uid`` is one user, or a frame (uid, table) of users; then rows are grouped by user.
    The sort is a range exchange over (user, time), so one user's rows may span tasks.
    """
    listed = visible(sessions, "chat_sessions", uid).select(
        "*",
        shown_title("title").alias("shown_title"),
        date_text("updated_at").alias("shown_date"),
        datetime_text("updated_at").alias("shown_time"),
    )
    lead = ["user_id"] if isinstance(uid, DataFrame) else []
    return listed.orderBy(*lead, F.desc("updated_at"), "id")


def list_messages(messages: DataFrame, uid, session_id=None) -> DataFrame:
    """Visible messages of a session as (role, text), oldest first.

    With a frame of users and no session, every visible message, grouped by session.
    """
    seen = visible(messages, "chat_messages", uid)
    if session_id is not None:
        seen = seen.where(F.col("session_id") == F.lit(session_id))
        return seen.orderBy("created_at", "id").select("role", F.col("content").alias("text"))
    return seen.orderBy("session_id", "created_at", "id").select(
        "user_id", "session_id", "id", "role", F.col("content").alias("text")
    )


def find_session(sessions: DataFrame, session_id, uid) -> DataFrame:
    """The id of one session if it is the user's; at most one row by the primary key, which
    ``quality.not_exactly_one`` checks.  No limit hides a duplicate."""
    owned = visible(sessions, "chat_sessions", uid)
    return owned.where(F.col("id") == F.lit(session_id)).select("id")


def title_sessions(drafts: DataFrame) -> DataFrame:
    """(session_id, title) from the first exchange of each session.

    ``drafts(session_id, id, created_at, text, attachments)`` are the user's messages as
    typed.  With an ``outcome`` column, a session whose first exchange was not answered
    gets no title.  Titles are short, so they are built before the per-session minimum;
    that keeps the map-side combine and the shuffle narrow.
    """
    first_name = F.get(F.col("attachments"), F.lit(0))["name"]
    # Without a session there is nothing to title (a guest).
    kept = drafts.where(F.col("session_id").isNotNull())
    answered = F.col("outcome") == "answer" if "outcome" in drafts.columns else F.lit(True)
    slim = kept.select(
        "session_id", "created_at", "id",
        title_base("text", first_name).alias("base"),
        F.coalesce(answered, F.lit(False)).alias("answered"),
    ).select("session_id", "created_at", "id", shorten_title("base").alias("title"), "answered")
    first = F.min_by(F.struct("title", "answered"), F.struct("created_at", "id"))
    return (
        slim.groupBy("session_id").agg(first.alias("first"))
        .where("first.answered")
        .select("session_id", F.col("first.title").alias("title"))
    )
