"""What is shown of each session, kept up to date while messages come and go: how many
messages it has, its last activity, and the title its first user message gives it.

A count can be taken back; a minimum or maximum cannot, so each session keeps its ``KEPT``
latest and its ``KEPT`` earliest user messages (time, id, and the title: no texts).  Removing
messages takes them off these lists.  What is left of a list is still right, down to its last
entry; only a session that has messages and has lost all entries of a list is looked up in
the table again.

Changes are narrow rows, reduced per session before they meet the summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.functions.text import shorten_title, title_base

KEPT = 4

def _entry() -> Column:
    no_file = F.lit(None).cast("string")
    return F.struct(F.col("created_at").alias("at"), "id", shorten_title(title_base("content", no_file)).alias("title"))


def _ends(messages: DataFrame, kept: int) -> DataFrame:
    """(session_id, latest, first): the last entries of a session, and its first ones by the
    user.  Map tasks keep no more of a session than that."""
    narrow = messages.select("session_id", "role", _entry().alias("e")).select("session_id", "role", "e.*")

    def end(rows: DataFrame, *order: Column) -> DataFrame:
        ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy(*order)))
        return ranked.where(F.col("rank") <= kept)

    last = end(narrow, F.desc("at"), F.desc("id")).groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "id", "title")), False).alias("latest"))
    first = end(narrow.where(F.col("role") == "user"), F.asc("at"), F.asc("id")).groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "id", "title"))).alias("first"))
    return last.join(first, "session_id", "left")


def summarise(messages: DataFrame, kept: int = KEPT) -> DataFrame:
    """The summaries of all sessions: ``session_id``, ``n``, ``n_user``, ``latest``, ``first``."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"))
    none = F.array().cast("array<struct<at:timestamp,id:bigint,title:string>>")
    return counts.join(_ends(messages, kept), "session_id").select(
        "session_id", "n", "n_user", "latest", F.coalesce("first", none).alias("first"))


def apply_to_summaries(
    summaries: DataFrame, added: DataFrame, removed: DataFrame, messages: DataFrame, kept: int = KEPT
) -> DataFrame:
    """The next summaries after messages were ``added`` and ``removed``.

    ``removed`` holds messages of the table as it was, ``messages`` is the table as it is: only
    the sessions whose lists ran out are read from it.  Sessions without messages are gone.
    """
    gone = removed.groupBy("session_id").agg(F.count("*").alias("less"), F.count_if(F.col("role") == "user").alias("less_user"))
    more = summarise(added, kept).select(
        "session_id", F.col("n").alias("more"), F.col("n_user").alias("more_user"), F.col("latest").alias("came"),
        F.col("first").alias("came_first"))
    # Entries that were removed, of the few there are.
    entries = summaries.select("session_id", F.explode(F.array_union("latest", "first")).alias("e")).select("session_id", F.col("e.id").alias("id"))
    lost = entries.join(removed.select("session_id", "id"), ["session_id", "id"], "left_semi").groupBy("session_id").agg(
        F.collect_set("id").alias("lost"))
    none = F.array().cast("array<struct<at:timestamp,id:bigint,title:string>>")
    met = summaries.join(gone, "session_id", "left").join(lost, "session_id", "left").join(more, "session_id", "full_outer")
    zero = F.lit(0).cast("long")
    held = {c: F.coalesce(c, none) for c in ("latest", "first", "came", "came_first")}
    lost_ids = F.coalesce("lost", F.array().cast("array<bigint>"))
    left = {c: F.filter(held[c], lambda e: ~F.array_contains(lost_ids, e["id"])) for c in ("latest", "first")}

    def merged(old: Column, new: Column, all_: Column, newest: bool) -> Column:
        """Entries down to the last old one; beyond it rows that no list holds may stand."""
        both = F.sort_array(F.array_union(old, new), not newest)
        edge = F.try_element_at(old, F.lit(-1))
        sure = F.filter(both, lambda e: all_ | ((e >= edge) if newest else (e <= edge)))
        return F.slice(sure, 1, kept)

    n = F.coalesce("n", zero) - F.coalesce("less", zero)
    n_user = F.coalesce("n_user", zero) - F.coalesce("less_user", zero)
    told = met.select(
        "session_id", (n + F.coalesce("more", zero)).alias("n"), (n_user + F.coalesce("more_user", zero)).alias("n_user"),
        merged(F.when(F.size(left["latest"]) > 0, left["latest"]).otherwise(none), held["came"],
               n == F.size(left["latest"]), True).alias("latest"),
        merged(F.when(F.size(left["first"]) > 0, left["first"]).otherwise(none), held["came_first"],
               n_user == F.size(left["first"]), False).alias("first"),
    ).where("n > 0")
    out = (F.size("latest") == 0) | ((F.size("first") == 0) & (F.col("n_user") > 0))
    again = told.where(out).select("session_id")
    return told.where(~out).unionByName(summarise(messages.join(again, "session_id", "left_semi"), kept))


def shown(summaries: DataFrame) -> DataFrame:
    """(session_id, n_messages, last_at, title); no title before the user has written."""
    return summaries.select(
        "session_id", F.col("n").alias("n_messages"), F.get("latest", F.lit(0))["at"].alias("last_at"),
        F.get("first", F.lit(0))["title"].alias("title"))
