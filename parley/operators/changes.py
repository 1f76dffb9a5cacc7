"""Snapshot change application: upsert, update, delete, cascade, touch.

A table and a batch of changes go in, the next snapshot comes out.  Changes are folded to
one row per key with aggregates that combine map-side, so a key changed a billion times
reaches the shuffle as one row per task; only then do they meet the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.functions.text import DEFAULT_TITLE, falsy, js_trim, or_else, placeholder_email, shown_title


STRETCHES = 64  # of a batch's changes in order, at most


def _as_column(now):
    return now if not isinstance(now, str) else F.to_timestamp(F.lit(now))


def latest(changes: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """The last change of each key by ``order``."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return changes.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*")


def upsert_profiles(profiles: DataFrame, changes: DataFrame, now, order: list[str] | None = None) -> DataFrame:
    """Insert or refresh profiles from (id, email); all other columns are kept.

    ``order`` names the columns that order several changes to one id; without it the
    changes must hold one row per id.  Refreshed rows get ``updated_at = now``.
    """
    now = _as_column(now)
    changes = changes.where(F.col("id").isNotNull())
    if order:
        changes = latest(changes, ["id"], ["email"], order)
    new = changes.select(
        F.col("id"), placeholder_email("email", "id").alias("new_email"), F.lit(True).alias("hit")
    )
    hit = F.coalesce("hit", F.lit(False))
    changed = {
        "email": F.coalesce("new_email", "email"),
        "created_at": F.coalesce("created_at", now),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return profiles.join(new, "id", "full_outer").select(
        *[changed.get(c, F.col(c)).alias(c) for c in profiles.columns]
    )


def update_titles(sessions: DataFrame, changes: DataFrame, now, order: list[str]):
    """Set titles by (id, user_id); returns (next sessions, updated rows, unmatched changes).

    Each change must hit exactly one session of its user; ``order`` names the columns that
    order several changes to one session.  A change that hits none is an error and comes
    back as unmatched; an empty title becomes the default title.
    """
    now = _as_column(now)
    keys = ["id", "user_id"]
    folded = latest(changes, keys, ["title"], order)
    new = folded.select(*keys, or_else("title", F.lit(DEFAULT_TITLE)).alias("new_title"))
    joined = sessions.join(new, keys, "left")
    changed = {
        "title": F.coalesce("new_title", "title"),
        "updated_at": F.when(F.col("new_title").isNotNull(), now).otherwise(F.col("updated_at")),
    }
    after = [changed.get(c, F.col(c)).alias(c) for c in sessions.columns]
    updated = sessions.join(new, keys).select(*after)
    unmatched = changes.join(sessions.select(*keys), keys, "left_anti").select(*changes.columns)
    return joined.select(*after), updated, unmatched


def rename_requests(changes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Drop renames that would change nothing: blank, or equal to the title on display."""
    trimmed = changes.withColumn("title", js_trim("title")).where(~falsy("title"))
    shown = sessions.select("id", "user_id", shown_title("title").alias("shown"))
    # A session the caller cannot see has no title to compare with; the update rejects it.
    return (
        trimmed.join(shown, ["id", "user_id"], "left")
        .where(F.col("shown").isNull() | (F.col("title") != F.col("shown")))
        .select(*changes.columns)
    )


def delete_sessions(sessions: DataFrame, messages: DataFrame, keys: DataFrame):
    """Delete sessions by (id, user_id) with their messages.

    Keys that match nothing, or a session of somebody else, change nothing.  Returns the
    next (sessions, messages).
    """
    gone = sessions.select("id", "user_id").join(keys.select("id", "user_id"), ["id", "user_id"], "left_semi")
    return (
        sessions.join(keys.select("id", "user_id"), ["id", "user_id"], "left_anti").select(*sessions.columns),
        messages.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_anti")
        .select(*messages.columns),
    )


def cascade_delete(profiles: DataFrame, sessions: DataFrame, messages: DataFrame, keys: DataFrame):
    """Delete profiles by id with everything that hangs on them.

    Messages go with their session's owner as well as with their own.  Key sets can be of
    any size, so no join is forced to broadcast.  Returns the next (profiles, sessions,
    messages).
    """
    users = keys.select(F.col("id").alias("user_id"))
    next_sessions = sessions.join(users, "user_id", "left_anti").select(*sessions.columns)
    gone = sessions.join(users, "user_id", "left_semi").select(F.col("id").alias("session_id"))
    return (
        profiles.join(keys.select("id"), "id", "left_anti").select(*profiles.columns),
        next_sessions,
        messages.join(users, "user_id", "left_anti")
        .join(gone, "session_id", "left_anti")
        .select(*messages.columns),
    )


def touch_sessions(sessions: DataFrame, activity: DataFrame) -> DataFrame:
    """Move ``updated_at`` forward to the latest activity (session_id, last_at)."""
    latest_at = activity.select(F.col("session_id").alias("id"), "last_at")
    at = F.greatest("updated_at", "last_at")
    return sessions.join(latest_at, "id", "left").select(
        *[(at if c == "updated_at" else F.col(c)).alias(c) for c in sessions.columns]
    )


def remove_by_key(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti").select(*rows.columns)


def append_rows(rows: DataFrame, added: DataFrame, front: bool = False) -> DataFrame:
    """Bag union with an explicit ``part`` column, since a union has no order of its own."""
    return rows.withColumn("part", F.lit(1)).unionByName(added.withColumn("part", F.lit(0 if front else 2)))


def apply_changes(base: DataFrame, changes: DataFrame, key: str, now, order: list[str], few: bool = False):
    """Apply mixed changes; returns (next snapshot, unmatched changes).

    With ``few``, the keys that change are known to be few enough for a broadcast, and the
    rows of ``base`` are not shuffled.

    ``changes`` holds ``op`` (upsert, update or delete), the key, the ``order`` columns and
    the columns to set.  Changes count one after another in ``order`` (the first of its
    columns is a number or a time): an upsert creates or changes the row, an update needs
    one, a delete removes it, and the next upsert creates it anew, with NULL in the columns
    it does not set.  Unmatched are updates of a row that is not there at that moment, and
    upserts and updates without a key; deleting a missing key is a no-op.
    """
    now = _as_column(now)
    sets = [c for c in changes.columns if c in base.columns and c != key]
    at = F.struct(*order)
    keyed = changes.where(F.col(key).isNotNull())
    write = F.col("op").isin("upsert", "update")
    folded = keyed.groupBy(key).agg(
        F.max(F.when(F.col("op") == "upsert", at)).alias("upserted"),
        F.max(F.when(F.col("op") == "delete", at)).alias("deleted"),
        F.max_by(F.when(write, F.struct(*sets)), F.when(write, at)).alias("last"),
    )

    known = base.withColumn("known", F.lit(True))
    if few:
        there = base.join(F.broadcast(folded.select(key)), key, "left_semi").select(key)
        new = folded.join(F.broadcast(there), key, "left_anti")
        blank = {c: F.lit(None).cast(kind) for c, kind in known.dtypes if c != key}
        changed = [c for c in folded.columns if c != key]
        joined = known.join(F.broadcast(folded), key, "left").select(*known.columns, *changed).unionByName(
            new.select(key, *(v.alias(c) for c, v in blank.items()), *changed))
        base = there
    else:
        joined = known.join(folded, key, "full_outer")
    hit = F.col("last").isNotNull()
    anew = F.col("deleted").isNotNull()
    names = [c for c in known.columns if c != "known"]
    columns = {c: F.when(~anew, F.col(c)) for c in names if c != key}
    columns |= {c: F.when(hit, F.col(f"last.{c}")).otherwise(F.col(c)) for c in sets}
    if "updated_at" in names:
        columns["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    if "created_at" in names and "created_at" not in sets:
        columns["created_at"] = F.when(anew, now).otherwise(F.coalesce("created_at", now))
    exists = F.when(anew, F.col("upserted") > F.col("deleted")).otherwise(
        F.coalesce("known", F.col("upserted").isNotNull()))
    snapshot = joined.where(exists).select(*[columns.get(c, F.col(c)).alias(c) for c in names])

    unkeyed = changes.where(F.col(key).isNull() & write)
    return snapshot, _unmatched(base, keyed, key, order).select(*changes.columns).unionByName(unkeyed)


def _unmatched(base: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Updates of rows that are not there: what came last before each, an upsert or a delete?

    A key may hold much of the batch, so its changes are cut into stretches that hold about
    equally many changes, by quantiles of the first order column.  Inside a stretch a window
    finds the last upsert or delete; before its first one, what the stretches before it ended
    with counts, one row each, and before those, whether the table has the key.
    """
    stretches = min(int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")), STRETCHES)
    place = F.col(order[0]).cast("double")
    cuts = changes.agg(F.percentile_approx(place, [k / stretches for k in range(1, stretches)] or [0.5])).scalar()
    stretch = reduce(Column.__add__, [(F.get(cuts, F.lit(k)) < place).cast("long") for k in range(stretches - 1)], F.lit(0).cast("long"))
    marker = F.when(F.col("op").isin("upsert", "delete"), F.col("op"))
    placed = changes.withColumns({"_stretch": F.coalesce(stretch, F.lit(0)), "_marker": marker})
    ends = placed.groupBy(key, "_stretch").agg(F.max_by("_marker", F.when(F.col("_marker").isNotNull(), F.struct(*order))).alias("_end"))
    earlier = W.partitionBy(key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    known = base.select(key, F.lit("upsert").alias("_known"))
    starts = ends.withColumn("_start", F.last("_end", ignorenulls=True).over(earlier)).join(known, key, "left").select(
        key, "_stretch", F.coalesce("_start", "_known", F.lit("delete")).alias("_start"))
    inside = W.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    told = placed.withColumn("_before", F.last("_marker", ignorenulls=True).over(inside)).where("op = 'update'")
    return told.join(starts, [key, "_stretch"]).where(F.coalesce("_before", "_start") == "delete")


def replace_by_key(rows: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Swap in the changed version of each row that has one."""
    new = changed.select(key, F.struct(*changed.columns).alias("new"))
    return rows.join(new, key, "left").select(
        *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in rows.columns]
    )
