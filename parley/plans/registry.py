"""Named queries: each operator over the whole test tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from parley import schemas
from parley.functions import replies as reply_functions, text
from parley.operators import access, attachments, changes, ingest, prompts, quality, replies, sessions, summaries, throttle
from parley.plans import oracle
from parley.plans.explode import explode_rows
from parley.plans.fixtures import Tables, now, pick
from parley.plans.oracle import NOW, SYSTEM, or_else, stamp, title, trim
from parley.session import run_folder, stored
from parley.sources import sinks, snapshots, tables as readers, uploads
from parley.streaming import messages, responses as pairing, throttle as streams

# Status codes, messages and model names in the statements below are fixed values.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(statement: str | None = None):
    """Register ``fn(t: Tables)`` under its own name, with the SQL it must agree with."""

    def register(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if statement is not None:
            ORACLES[name] = oracle.sql(statement)
        return fn

    return register


def timed(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text, so that results compare without a time-zone convention."""
    return df.withColumns({c: text.datetime_text(c) for c in columns})


def callers(t: Tables, *names: str) -> DataFrame:
    """Every user, granted access to the named tables."""
    granted = F.explode(F.array(*[F.lit(n) for n in names]))
    return t.profiles().select(F.col("id").alias("uid"), granted.alias("table"))


# --- listings and access ------------------------------------------------------------


def in_order(listed: DataFrame, *groups: str) -> DataFrame:
    """``position`` of each row in its group, by the order the rows come out in."""
    seen = listed.withColumn("seen", F.monotonically_increasing_id())
    return seen.withColumn("position", F.row_number().over(W.partitionBy(*groups).orderBy("seen")).cast("long")).drop("seen")


@query(f"""
    SELECT user_id, id, {or_else('title', "'Untitled chat'")} AS shown_title,
           strftime(last_at, '%Y-%m-%d') AS shown_date, {stamp('last_at')} AS shown_time
    FROM v_sessions JOIN (SELECT session_id, max(created_at) AS last_at FROM v_messages GROUP BY session_id) a
      ON a.session_id = id
    WHERE user_id IN (SELECT id FROM v_profiles)""")
def session_overview(t: Tables) -> DataFrame:
    touched = changes.touch_sessions(t.sessions(), sessions.last_activity(t.messages()))
    listed = sessions.list_sessions(touched, callers(t, "chat_sessions"))
    return listed.select("user_id", "id", "shown_title", "shown_date", "shown_time")


@query(f"""
    SELECT user_id, id, {or_else('title', "'Untitled chat'")} AS shown_title, {stamp('updated_at')} AS shown_time,
           row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS position
    FROM v_sessions WHERE user_id IN (SELECT id FROM v_profiles)""")
def list_sessions(t: Tables) -> DataFrame:
    listed = sessions.list_sessions(t.sessions(), callers(t, "chat_sessions"))
    return in_order(listed, "user_id").select("user_id", "id", "shown_title", "shown_time", "position")


@query("""
    SELECT user_id, session_id, id, role, content AS text,
           row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS position
    FROM v_messages WHERE user_id IN (SELECT id FROM v_profiles)""")
def list_messages(t: Tables) -> DataFrame:
    return in_order(sessions.list_messages(t.messages(), callers(t, "chat_messages")), "session_id")


@query("""
    SELECT role, content AS text, row_number() OVER (ORDER BY created_at, id) AS position
    FROM v_messages WHERE session_id = (SELECT max(session_id) FROM v_messages)""")
def messages_of_session(t: Tables) -> DataFrame:
    """What one caller gets to see of one session: the newest, opened by its owner."""
    newest = t.messages().agg(F.max(F.struct("session_id", "user_id")).alias("m")).first().m
    return in_order(sessions.list_messages(t.messages(), newest.user_id, newest.session_id))


@query("""
    SELECT role, content AS text, row_number() OVER (ORDER BY created_at, id) AS position
    FROM v_messages WHERE session_id = (SELECT max(session_id) FROM v_messages)""")
def messages_of_session_clustered(t: Tables) -> DataFrame:
    """The same, from files in order of user, session and time."""
    folder = run_folder(t.spark, "clustered")
    sinks.write_clustered(t.messages(), folder)
    held = readers.read_table(t.spark, folder, "chat_messages")
    newest = held.agg(F.max(F.struct("session_id", "user_id")).alias("m")).first().m
    return in_order(sessions.list_messages(held, newest.user_id, newest.session_id))


@query("""
    SELECT 'owner' AS caller, max(session_id) AS id FROM v_messages""")
def find_session(t: Tables) -> DataFrame:
    """One session looked up by its owner and by a stranger, who finds nothing."""
    newest = t.messages().agg(F.max(F.struct("session_id", "user_id")).alias("m")).first().m
    found = [
        sessions.find_session(t.sessions(), newest.session_id, uid).select(F.lit(who).alias("caller"), "id")
        for who, uid in (("owner", newest.user_id), ("stranger", newest.user_id + 1))
    ]
    return reduce(DataFrame.unionByName, found)


@query(f"""
    , left_over AS (SELECT * FROM v_messages WHERE id % 3 <> 0 AND (session_id % 4 <> 1 OR id % 1000 < 2) AND session_id % 9 <> 5)
    SELECT session_id, n_messages, {stamp('last_at')} AS last_at,
           CASE WHEN base IS NOT NULL THEN {title("base")} END AS title
    FROM (SELECT session_id, count(*) AS n_messages, max(created_at) AS last_at,
                 min_by({or_else(trim('content'), "'New chat'")}, id) FILTER (role = 'user') AS base
          FROM left_over GROUP BY session_id)""")
def session_summaries(t: Tables) -> DataFrame:
    """Count, last activity and title after half of the messages came later and three rounds of
    deletes: scattered ones, all but the first of a session, whole sessions."""
    everything = stored(t.messages(), "messages")
    late = F.col("id") % 2 == 1
    kept = summaries.summarise(everything.where(~late))
    there = everything.where(~late)
    for added, removed in (
        (late, F.lit(False)), (F.lit(False), F.col("id") % 3 == 0),
        (F.lit(False), (F.col("session_id") % 4 == 1) & (F.col("id") % 1000 >= 2)), (F.lit(False), F.col("session_id") % 9 == 5),
    ):
        came = everything.where(added)
        gone = there.where(removed)
        there = (everything if added is late else there).where(~removed)
        kept = stored(summaries.apply_to_summaries(kept, came, gone, there), "summaries")
    return timed(summaries.shown(kept), "last_at").select("session_id", "n_messages", "last_at", "title")


@query("""
    SELECT 'profiles' AS "table", id FROM v_profiles
    UNION ALL SELECT 'chat_sessions', id FROM v_sessions WHERE user_id IN (SELECT id FROM v_profiles)
    UNION ALL SELECT 'chat_messages', id FROM v_messages WHERE user_id IN (SELECT id FROM v_profiles)""")
def rls_visible(t: Tables) -> DataFrame:
    grants = callers(t, "profiles", "chat_sessions", "chat_messages")
    parts = [
        access.visible(df, name, grants).select(F.lit(name).alias("table"), "id")
        for name, df in _model(t).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _model(t: Tables) -> dict[str, DataFrame]:
    return {"profiles": t.profiles(), "chat_sessions": t.sessions(), "chat_messages": t.messages()}


@query("""
    SELECT 'profiles' AS "table", command, CASE WHEN command = 'delete' THEN 0 ELSE n END AS n_rows
    FROM (SELECT count(*) AS n, unnest(['select', 'insert', 'update', 'delete']) AS command FROM v_profiles)
    UNION ALL
    SELECT 'chat_sessions', command, n
    FROM (SELECT count(*) AS n, unnest(['select', 'insert', 'update', 'delete']) AS command
          FROM v_sessions WHERE user_id IN (SELECT id FROM v_profiles))
    UNION ALL
    SELECT 'chat_messages', command, CASE WHEN command IN ('select', 'insert') THEN n ELSE 0 END
    FROM (SELECT count(*) AS n, unnest(['select', 'insert', 'update', 'delete']) AS command
          FROM v_messages WHERE user_id IN (SELECT id FROM v_profiles))""")
def rls_matrix(t: Tables) -> DataFrame:
    """How many rows each command may touch, all users taken together."""
    grants = callers(t, "profiles", "chat_sessions", "chat_messages")
    parts = [
        access.visible(df, name, grants, command)
        .agg(F.count("*").alias("n_rows"))
        .select(F.lit(name).alias("table"), F.lit(command).alias("command"), "n_rows")
        for name, df in _model(t).items()
        for command in ("select", "insert", "update", "delete")
    ]
    return reduce(DataFrame.unionByName, parts)


@query("""
    SELECT t AS "table", command, CASE WHEN granted THEN n ELSE 0 END AS n_rows
    FROM (SELECT 'profiles' AS t, (SELECT count(*) FROM v_profiles WHERE id = c.uid) AS n FROM (SELECT max(user_id) AS uid FROM v_sessions) c
          UNION ALL SELECT 'chat_sessions', (SELECT count(*) FROM v_sessions WHERE user_id = c.uid) FROM (SELECT max(user_id) AS uid FROM v_sessions) c
          UNION ALL SELECT 'chat_messages', (SELECT count(*) FROM v_messages WHERE user_id = c.uid) FROM (SELECT max(user_id) AS uid FROM v_sessions) c)
    JOIN (VALUES ('profiles', 'select', true), ('profiles', 'insert', true), ('profiles', 'update', true), ('profiles', 'delete', false),
                 ('chat_sessions', 'select', true), ('chat_sessions', 'insert', true), ('chat_sessions', 'update', true), ('chat_sessions', 'delete', true),
                 ('chat_messages', 'select', true), ('chat_messages', 'insert', true), ('chat_messages', 'update', false), ('chat_messages', 'delete', false)
         ) p(tab, command, granted) ON p.tab = t""")
def rls_matrix_sql(t: Tables) -> DataFrame:
    """What one caller may touch by each command, asked in SQL through the policies' views."""
    access.install_policies(t.spark, _model(t))
    access.as_caller(t.spark, t.sessions().agg(F.max("user_id")).first()[0])
    counted = " UNION ALL ".join(
        f"SELECT '{table}' AS `table`, '{command}' AS command, count(*) AS n_rows FROM {table}_for_{command}"
        for table in access.POLICIES for command in access.COMMANDS)
    # Stored: the variable may change before the rows are read.
    return stored(t.spark.sql(counted), "policies")


@query("""
    SELECT id, COALESCE(user_id = id % 10, false) AS allowed FROM v_incoming""")
def rls_write_check_sql(t: Tables) -> DataFrame:
    access.install_policies(t.spark, _model(t))
    _written_rows(t).createOrReplaceTempView("written_messages")
    return t.spark.sql("SELECT id, may('chat_messages', 'insert', user_id, uid) AS allowed FROM written_messages")


def _written_rows(t: Tables) -> DataFrame:
    """Incoming rows that claim the conversation's owner, with the identity of the writer."""
    return t.incoming().withColumn("uid", F.col("user_id")).withColumn("user_id", F.col("id").cast("long") % 10)


@query("""
    SELECT id, COALESCE(user_id = id % 10, false) AS allowed FROM v_incoming""")
def rls_write_check(t: Tables) -> DataFrame:
    accepted, rejected = access.check_writes(_written_rows(t), "chat_messages", "insert")
    return accepted.select("id", F.lit(True).alias("allowed")).unionByName(
        rejected.select("id", F.lit(False).alias("allowed"))
    )


@query(f"SELECT session_id, {stamp('max(created_at)')} AS last_at FROM v_messages GROUP BY session_id")
def last_activity(t: Tables) -> DataFrame:
    return timed(sessions.last_activity(t.messages()), "last_at")


@query("""
    SELECT s.id AS session_id, count(m.id) AS n_messages, count(m.id) = 0 AS is_empty
    FROM v_sessions s LEFT JOIN (SELECT * FROM v_dirty_messages) m ON m.session_id = s.id GROUP BY s.id""")
def message_counts(t: Tables) -> DataFrame:
    return sessions.message_counts(t.sessions(), t.dirty_messages())


# --- saving messages ----------------------------------------------------------------


@query("""
    SELECT m.id, m.session_id, m.user_id FROM v_incoming m
    WHERE EXISTS (SELECT 1 FROM v_sessions s WHERE s.id = m.session_id AND s.user_id = m.user_id)""")
def ownership_semi(t: Tables) -> DataFrame:
    return ingest.owned(t.incoming(), t.sessions()).select("id", "session_id", "user_id")


@query("""
    SELECT m.id FROM v_incoming m
    WHERE NOT EXISTS (SELECT 1 FROM v_sessions s WHERE s.id = m.session_id AND s.user_id = m.user_id)""")
def ownership_anti(t: Tables) -> DataFrame:
    return ingest.not_owned(t.incoming(), t.sessions()).select("id")


@query("""
    SELECT id, status,
           CASE status WHEN 401 THEN 'Unauthorized' WHEN 400 THEN 'Session ID, Role, and Content are required'
                       WHEN 404 THEN 'Session not found' WHEN 500 THEN 'Failed to save message' END AS reason
    FROM v_status""")
def status_decision(t: Tables) -> DataFrame:
    return ingest.classify_messages(t.incoming(), t.sessions()).select("id", "status", "reason")


@query("""
    SELECT id, CASE WHEN user_id IS NULL THEN 401 ELSE 400 END AS status FROM v_incoming
    WHERE user_id IS NULL OR session_id IS NULL OR COALESCE(role, '') = '' OR COALESCE(content, '') = ''""")
def required_fields(t: Tables) -> DataFrame:
    return t.incoming().withColumn("status", ingest.early_status()).where("status IS NOT NULL").select("id", "status")


def _ingested(t: Tables) -> ingest.Ingested:
    return ingest.ingest_messages(t.incoming(), t.sessions(), t.profiles(), now())


@query(f"""
    SELECT id, session_id, user_id, role, content, {stamp('created_at')} AS created_at FROM v_status WHERE status = 200""")
def ingest_accepted(t: Tables) -> DataFrame:
    return timed(_ingested(t).accepted, "created_at")


@query("SELECT id, status FROM v_status WHERE status <> 200")
def ingest_rejected(t: Tables) -> DataFrame:
    return _ingested(t).rejected.select("id", "status")


@query(f"""
    SELECT s.id, s.user_id, s.title, {stamp('greatest(s.updated_at, max(m.created_at))')} AS updated_at
    FROM v_sessions s LEFT JOIN v_status m ON m.session_id = s.id AND m.status = 200
    GROUP BY s.id, s.user_id, s.title, s.updated_at""")
def ingest_sessions(t: Tables) -> DataFrame:
    return timed(_ingested(t).sessions, "updated_at").select("id", "user_id", "title", "updated_at")


@query(f"""
    SELECT COALESCE(p.id, w.id) AS id,
           CASE WHEN w.id IS NULL THEN p.email ELSE {or_else('w.email', "w.id || '@local.invalid'")} END AS email, p.first_name,
           {stamp(f"COALESCE(p.created_at, {NOW})")} AS created_at,
           {stamp(f"CASE WHEN w.id IS NULL THEN p.updated_at ELSE {NOW} END")} AS updated_at
    FROM v_profiles p FULL JOIN (
        SELECT user_id AS id, arg_max(email, created_at + to_microseconds(id)) AS email
        FROM v_status WHERE status NOT IN (401, 400) GROUP BY user_id) w ON w.id = p.id""")
def ingest_profiles(t: Tables) -> DataFrame:
    return timed(_ingested(t).profiles, "created_at", "updated_at").select(
        "id", "email", "first_name", "created_at", "updated_at"
    )


# --- constraints ----------------------------------------------------------------------


@query('SELECT "table", constraint_name, key, detail FROM v_constraints')
def check_constraints(t: Tables) -> DataFrame:
    return _renamed(
        quality.check_constraints(t.dirty_profiles(), t.dirty_sessions(), t.dirty_messages(), t.signups())
    )


@query('SELECT "table", constraint_name, key, detail FROM v_constraints')
def constraint_upkeep(t: Tables) -> DataFrame:
    """The same report, kept up to date: counts of two thirds of the rows and of sessions of
    nobody's, then a batch that brings the rest, and one that takes those sessions away."""
    tables = {"profiles": t.dirty_profiles(), "chat_sessions": t.dirty_sessions(), "chat_messages": t.dirty_messages()}
    names = {*tables, "signups"}
    late = F.coalesce(F.col("id") % 3 == 0, F.lit(False))
    strays = t.dirty_sessions().where("id % 5 = 0").withColumn("user_id", F.col("id") + 5_000_000)
    first = {name: df.where(~late) for name, df in tables.items()} | {"signups": t.signups()}
    first["chat_sessions"] = first["chat_sessions"].unionByName(strays)
    counts = stored(quality.constraint_counts(first), "constraint-counts")
    for batch in (
        {name: df.where(late).withColumn("sign", F.lit(1)) for name, df in tables.items()},
        {"chat_sessions": strays.withColumn("sign", F.lit(-1))},
    ):
        counts = stored(quality.apply_to_counts(counts, batch, names), "constraint-counts")
    return _renamed(quality.violations(counts))


def _renamed(report: DataFrame) -> DataFrame:
    return report.withColumnRenamed("constraint", "constraint_name")


@query("SELECT \"table\", constraint_name, key, detail FROM v_constraints WHERE constraint_name LIKE 'not_null:%'")
def not_null(t: Tables) -> DataFrame:
    tables = {"profiles": t.dirty_profiles(), "chat_sessions": t.dirty_sessions(), "chat_messages": t.dirty_messages()}
    parts = [quality.null_violations(df, name) for name, df in tables.items()]
    return _renamed(reduce(DataFrame.unionByName, parts))


@query("SELECT \"table\", constraint_name, key, detail FROM v_constraints WHERE constraint_name = 'unique:email'")
def unique_email(t: Tables) -> DataFrame:
    return _renamed(quality.duplicate_keys(t.dirty_profiles(), "profiles", "email"))


@query("""
    SELECT "table", constraint_name, key, detail FROM v_constraints WHERE constraint_name LIKE 'foreign_key:session_id%'""")
def fk_orphans(t: Tables) -> DataFrame:
    return _renamed(
        quality.orphans(t.dirty_messages(), "chat_messages", "session_id", t.sessions(), "chat_sessions")
    )


@query("SELECT id, role FROM v_messages WHERE role NOT IN ('user', 'assistant')")
def role_check(t: Tables) -> DataFrame:
    return quality.bad_roles(t.messages()).select(F.col("key").cast("long").alias("id"), F.col("detail").alias("role"))


@query("""
    SELECT w.id, count(p.id) AS n FROM (SELECT DISTINCT id FROM v_profile_changes) w
    LEFT JOIN v_dirty_profiles p ON p.id = w.id GROUP BY w.id HAVING count(p.id) <> 1""")
def cardinality(t: Tables) -> DataFrame:
    return quality.not_exactly_one(t.dirty_profiles(), t.profile_changes(), "id")


# --- change application -----------------------------------------------------------------


@query("""
    , gone AS (SELECT id FROM v_profile_delete_keys),
         gone_sessions AS (SELECT id FROM v_sessions WHERE user_id IN (SELECT id FROM gone))
    SELECT 'profiles' AS "table", id FROM v_profiles WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'chat_sessions', id FROM v_sessions WHERE user_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'chat_messages', id FROM v_messages
    WHERE user_id NOT IN (SELECT id FROM gone) AND session_id NOT IN (SELECT id FROM gone_sessions)""")
def cascade_delete(t: Tables) -> DataFrame:
    kept = changes.cascade_delete(t.profiles(), t.sessions(), t.messages(), t.profile_delete_keys())
    parts = [df.select(F.lit(name).alias("table"), "id") for name, df in zip(_model(t), kept)]
    return reduce(DataFrame.unionByName, parts)


@query("""
    SELECT 'chat_sessions' AS "table", id FROM v_sessions
    WHERE (id, user_id) NOT IN (SELECT (id, user_id) FROM v_session_delete_keys)
    UNION ALL
    SELECT 'chat_messages', id FROM v_messages
    WHERE session_id NOT IN (SELECT s.id FROM v_sessions s JOIN v_session_delete_keys k
                             ON k.id = s.id AND k.user_id = s.user_id)""")
def delete_sessions(t: Tables) -> DataFrame:
    kept_sessions, kept_messages = changes.delete_sessions(t.sessions(), t.messages(), t.session_delete_keys())
    return kept_sessions.select(F.lit("chat_sessions").alias("table"), "id").unionByName(
        kept_messages.select(F.lit("chat_messages").alias("table"), "id")
    )


@query(f"""
    SELECT COALESCE(p.id, c.id) AS id,
           CASE WHEN c.id IS NULL THEN p.email ELSE {or_else('c.email', "c.id || '@local.invalid'")} END AS email, p.age,
           {stamp(f"COALESCE(p.created_at, {NOW})")} AS created_at,
           {stamp(f"CASE WHEN c.id IS NULL THEN p.updated_at ELSE {NOW} END")} AS updated_at
    FROM v_profiles p FULL JOIN (
        SELECT id, email FROM v_profile_changes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) c
      ON c.id = p.id""")
def upsert_profiles(t: Tables) -> DataFrame:
    upserted = changes.upsert_profiles(t.profiles(), t.profile_changes().select("id", "email", "seq"), now(), ["seq"])
    return timed(upserted, "created_at", "updated_at").select("id", "email", "age", "created_at", "updated_at")


@query(f"""
    SELECT s.id, s.user_id, CASE WHEN c.id IS NULL THEN s.title ELSE {or_else('c.title', "'New Chat'")} END AS title,
           {stamp(f"CASE WHEN c.id IS NULL THEN s.updated_at ELSE {NOW} END")} AS updated_at
    FROM v_sessions s LEFT JOIN v_title_edits c ON c.id = s.id AND c.user_id = s.user_id
     AND NOT EXISTS (SELECT 1 FROM v_title_edits d WHERE d.id = c.id AND d.user_id = c.user_id AND d.seq > c.seq)""")
def update_titles(t: Tables) -> DataFrame:
    after, _, _ = changes.update_titles(t.sessions(), t.title_edits(), now(), ["seq"])
    return timed(after, "updated_at").select("id", "user_id", "title", "updated_at")


@query("""
    SELECT id, user_id, title, seq FROM v_title_edits c
    WHERE NOT EXISTS (SELECT 1 FROM v_sessions s WHERE s.id = c.id AND s.user_id = c.user_id)""")
def update_titles_unmatched(t: Tables) -> DataFrame:
    _, _, unmatched = changes.update_titles(t.sessions(), t.title_edits(), now(), ["seq"])
    return unmatched.select("id", "user_id", "title", "seq")


@query(f"""
    SELECT c.id, {trim('c.title')} AS title FROM v_title_changes c LEFT JOIN v_sessions s ON s.id = c.id AND s.user_id = c.user_id
    WHERE {trim('c.title')} <> '' AND (s.id IS NULL OR {trim('c.title')} <> {or_else('s.title', "'Untitled chat'")})""")
def rename_noop(t: Tables) -> DataFrame:
    return changes.rename_requests(t.title_changes(), t.sessions()).select("id", "title")


@query(f"""
    SELECT s.id, {stamp('greatest(s.updated_at, max(m.created_at))')} AS updated_at
    FROM v_sessions s LEFT JOIN v_dirty_messages m ON m.session_id = s.id GROUP BY s.id, s.updated_at""")
def touch_sessions(t: Tables) -> DataFrame:
    touched = changes.touch_sessions(t.sessions(), sessions.last_activity(t.dirty_messages()))
    return timed(touched, "updated_at").select("id", "updated_at")


@query("""
    SELECT id, title, 1 AS part FROM v_sessions UNION ALL SELECT id, title, 0 FROM v_title_changes""")
def union_append(t: Tables) -> DataFrame:
    return changes.append_rows(
        t.sessions().select("id", "title"), t.title_changes().select("id", "title"), front=True
    )


@query("SELECT id, title FROM v_sessions WHERE id NOT IN (SELECT id FROM v_session_delete_keys)")
def remove_by_key(t: Tables) -> DataFrame:
    return changes.remove_by_key(t.sessions(), t.session_delete_keys()).select("id", "title")


@query("""
    SELECT s.id, c.title FROM v_sessions s JOIN v_title_changes c ON c.id = s.id""")
def replace_by_key(t: Tables) -> DataFrame:
    changed = t.sessions().drop("title", "user_id").join(t.title_changes(), "id").select(*t.sessions().columns)
    return changes.replace_by_key(t.sessions(), changed).select("id", "title")


# Every key's changes, walked through one by one.
_WALK = f"""
    , numbered AS (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM v_profile_changes WHERE id IS NOT NULL),
    walk AS (
        SELECT k.id, CAST(0 AS BIGINT) AS n, p.id IS NOT NULL AS there, p.email, p.age, p.created_at, p.updated_at
        FROM (SELECT id FROM v_profiles UNION SELECT id FROM numbered) k LEFT JOIN v_profiles p ON p.id = k.id
        UNION ALL
        SELECT w.id, c.n, CASE c.op WHEN 'delete' THEN false WHEN 'upsert' THEN true ELSE w.there END,
               CASE WHEN c.op = 'delete' THEN NULL WHEN c.op = 'upsert' OR w.there THEN c.email END,
               CASE WHEN c.op <> 'delete' THEN w.age END,
               CASE WHEN c.op = 'delete' THEN NULL WHEN c.op = 'upsert' AND NOT w.there THEN {NOW} ELSE w.created_at END,
               CASE WHEN c.op = 'delete' THEN NULL WHEN c.op = 'upsert' OR w.there THEN {NOW} END
        FROM walk w JOIN numbered c ON c.id = w.id AND c.n = w.n + 1)"""


@query(f"""{_WALK}
    SELECT id, email, age, {stamp('created_at')} AS created_at, {stamp('updated_at')} AS updated_at
    FROM walk w WHERE there AND n = (SELECT count(*) FROM numbered c WHERE c.id = w.id)""")
def apply_changes(t: Tables) -> DataFrame:
    snapshot, _ = changes.apply_changes(t.profiles(), t.profile_changes(), "id", now(), ["seq"])
    return timed(snapshot, "created_at", "updated_at").select("id", "email", "age", "created_at", "updated_at")


@query(f"""{_WALK}
    SELECT id, email, age, {stamp('created_at')} AS created_at, {stamp('updated_at')} AS updated_at
    FROM walk w WHERE there AND n = (SELECT count(*) FROM numbered c WHERE c.id = w.id)""")
def apply_changes_buckets(t: Tables) -> DataFrame:
    """The same changes in two rounds, on a table in buckets."""
    folder = run_folder(t.spark, "profiles")
    log = stored(t.profile_changes(), "profile-changes")
    table = snapshots.BucketedTable(t.spark, folder, "id", schemas.PROFILES)
    table.create(t.profiles())
    middle = F.lit(log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0])
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        table.apply(log.where(part), now(), ["seq"])
    return timed(table.read(), "created_at", "updated_at").select("id", "email", "age", "created_at", "updated_at")


@query(f"""{_WALK}
    SELECT c.id, c.seq, c.op FROM walk w JOIN numbered c ON c.id = w.id AND c.n = w.n + 1 WHERE c.op = 'update' AND NOT w.there
    UNION ALL SELECT id, seq, op FROM v_profile_changes WHERE id IS NULL AND op <> 'delete'""")
def apply_changes_unmatched(t: Tables) -> DataFrame:
    _, unmatched = changes.apply_changes(t.profiles(), t.profile_changes(), "id", now(), ["seq"])
    return unmatched.select("id", "seq", "op")


@query(f"""
    SELECT substring(m, 1, 8) || '-' || substring(m, 9, 4) || '-' || substring(m, 13, 4) || '-' || substring(m, 17, 4)
           || '-' || substring(m, 21) AS id, user_id, title
    FROM (SELECT md5(CAST(id AS VARCHAR)) AS m, user_id, {or_else('title', "'New Chat'")} AS title FROM v_sessions)""")
def new_sessions(t: Tables) -> DataFrame:
    return sinks.new_sessions(t.sessions().select("id", "user_id", "title"), now(), "id").select("id", "user_id", "title")


def _saved_sessions(t: Tables) -> ingest.SavedSessions:
    new_id = F.col("request_id") + 5000000
    return ingest.save_sessions(t.session_requests(), t.sessions(), t.profiles(), now(), new_id)


@query(f"""
    SELECT s.id, s.user_id, CASE WHEN r.request_id IS NULL THEN s.title ELSE {or_else('r.title', "'New Chat'")} END AS title,
           {stamp(f"CASE WHEN r.request_id IS NULL THEN s.updated_at ELSE {NOW} END")} AS updated_at
    FROM v_sessions s LEFT JOIN v_session_requests r ON r.update_id = s.id AND r.user_id = s.user_id
    UNION ALL
    SELECT request_id + 5000000, user_id, {or_else('title', "'New Chat'")}, {stamp(NOW)}
    FROM v_session_requests WHERE update_id IS NULL AND user_id IS NOT NULL""")
def save_sessions(t: Tables) -> DataFrame:
    return timed(_saved_sessions(t).sessions, "updated_at").select("id", "user_id", "title", "updated_at")


@query(f"""
    SELECT request_id, request_id + CASE WHEN update_id IS NULL THEN 5000000 ELSE 0 END AS id, {or_else('title', "'New Chat'")} AS title
    FROM v_session_requests r
    WHERE user_id IS NOT NULL
      AND (update_id IS NULL OR EXISTS (SELECT 1 FROM v_sessions s WHERE s.id = r.update_id AND s.user_id = r.user_id))""")
def save_sessions_returned(t: Tables) -> DataFrame:
    return _saved_sessions(t).returned.select("request_id", "id", "title")


@query("""
    SELECT request_id, CASE WHEN user_id IS NULL THEN 401 ELSE 500 END AS status,
           CASE WHEN user_id IS NULL THEN 'Unauthorized' ELSE 'Failed to create session' END AS reason
    FROM v_session_requests r
    WHERE user_id IS NULL
       OR (update_id IS NOT NULL
           AND NOT EXISTS (SELECT 1 FROM v_sessions s WHERE s.id = r.update_id AND s.user_id = r.user_id))""")
def save_sessions_rejected(t: Tables) -> DataFrame:
    return _saved_sessions(t).rejected


# --- profiles ------------------------------------------------------------------------------


@query("""
    SELECT id, email, NULLIF(user_metadata ->> '$.first_name', '') AS first_name,
           NULLIF(user_metadata ->> '$.last_name', '') AS last_name,
           CASE WHEN regexp_matches(user_metadata ->> '$.age', '\\A[0-9]+\\z')
                THEN TRY_CAST(user_metadata ->> '$.age' AS INTEGER) END AS age,
           NULLIF(user_metadata ->> '$.gender', '') AS gender, NULLIF(user_metadata ->> '$.grade_year', '') AS grade_year
    FROM v_signups""")
def build_profiles(t: Tables) -> DataFrame:
    return ingest.build_profiles(t.signups(), now()).drop("created_at", "updated_at")


@query(f"""
    SELECT id, {or_else('first_name', "split_part(email, '@', 1)", "'Student'")} AS display_name FROM v_profiles""")
def display_name(t: Tables) -> DataFrame:
    return t.profiles().select("id", text.display_name("first_name", "email").alias("display_name"))


@query("""
    SELECT id, CASE WHEN regexp_matches(user_metadata ->> '$.age', '\\A[0-9]+\\z')
                    THEN TRY_CAST(user_metadata ->> '$.age' AS INTEGER) END AS age
    FROM v_signups""")
def age_strict(t: Tables) -> DataFrame:
    return t.signups().select("id", text.age_strict(F.get_json_object("user_metadata", "$.age")).alias("age"))


@query("""
    SELECT id, TRY_CAST(NULLIF(regexp_extract(user_metadata ->> '$.age', '\\A\\s*([+-]?[0-9]+)', 1), '') AS INTEGER) AS age
    FROM v_signups""")
def age_lenient(t: Tables) -> DataFrame:
    return t.signups().select("id", text.age_lenient(F.get_json_object("user_metadata", "$.age")).alias("age"))


# --- attachments -----------------------------------------------------------------------------


@query("""
    SELECT batch_id, pos, kind, fault IS NULL AS ok FROM v_examined""")
def attachment_route(t: Tables) -> DataFrame:
    return attachments.examine_files(t.files()).select("batch_id", "pos", "kind", F.col("code").isNull().alias("ok"))


@query("""
    SELECT batch_id, pos, CASE WHEN kind = 'image' THEN 'image' ELSE 'text' END AS type, name,
           CASE WHEN kind = 'image' THEN NULL ELSE content END AS content,
           CASE WHEN kind = 'image' THEN data_url END AS data_url
    FROM v_examined WHERE fault IS NULL""")
def ingest_attachments(t: Tables) -> DataFrame:
    return attachments.ingest_attachments(t.files()).attached.withColumnRenamed("dataUrl", "data_url")


@query("""
    SELECT batch_id, count(*) AS n_files, count(*) > greatest(0, 6 - max(pending)) AS over_cap FROM v_files GROUP BY batch_id""")
def attachment_cap(t: Tables) -> DataFrame:
    return attachments.batch_sizes(t.files())


@query("SELECT batch_id, pos, code, message FROM v_errors")
def attachment_errors(t: Tables) -> DataFrame:
    return attachments.ingest_attachments(t.files()).errors


_STATUS = """
    SELECT b.batch_id, b.n_files, COALESCE(x.attached, 0) AS attached, COALESCE(e.errors, 0) AS errors,
           CASE WHEN x.attached > 0 THEN x.attached || ' file(s) attached. Add a prompt or send files directly.'
                WHEN e.errors > 0 THEN 'No files were attached.' ELSE '' END AS status,
           COALESCE(e.shown, '') || CASE WHEN e.errors > 4 THEN chr(10) || '...and ' || (e.errors - 4) || ' more.'
                                         ELSE '' END AS shown_errors
    FROM (SELECT batch_id, count(*) AS n_files FROM v_files GROUP BY batch_id) b
    LEFT JOIN (SELECT batch_id, count(*) FILTER (fault IS NULL) AS attached FROM v_examined GROUP BY batch_id) x
      ON x.batch_id = b.batch_id
    LEFT JOIN (SELECT batch_id, max(n) AS errors, string_agg(message, chr(10) ORDER BY pos) FILTER (k <= 4) AS shown
               FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS k,
                            count(*) OVER (PARTITION BY batch_id) AS n FROM v_errors)
               GROUP BY batch_id) e ON e.batch_id = b.batch_id"""


@query(f"SELECT batch_id, n_files, attached, errors, status FROM ({_STATUS})")
def attachment_status(t: Tables) -> DataFrame:
    return attachments.ingest_attachments(t.files()).batch_status.drop("shown_errors")


@query(f"SELECT batch_id, shown_errors FROM ({_STATUS})")
def attachment_errors_top4(t: Tables) -> DataFrame:
    return attachments.ingest_attachments(t.files()).batch_status.select("batch_id", "shown_errors")


@query("""
    SELECT batch_id, pos, CASE WHEN kind = 'image' THEN 'Image: ' ELSE 'Text: ' END || name AS label,
           'File: ' || name AS file_label
    FROM v_examined WHERE fault IS NULL""")
def attachment_labels(t: Tables) -> DataFrame:
    return attachments.ingest_attachments(t.files()).attached.select(
        "batch_id", "pos", text.attachment_label("type", "name").alias("label"), text.file_label("name").alias("file_label")
    )


@query(f"""
    SELECT doc_id AS file_id,
           substring({trim("CASE WHEN doc_id % 3 = 0 THEN '  ' || chr(10) || chr(10) ELSE '' END || text")}, 1, 8000) AS text
    FROM documents""")
def join_pages(t: Tables) -> DataFrame:
    return attachments.join_pages(t.pages())


@query(f"""
    SELECT doc_id AS file_id,
           substring({trim("CASE WHEN doc_id % 3 = 0 THEN '  ' || chr(10) || chr(10) ELSE '' END || text")}, 1, 8000) AS text
    FROM documents""")
def join_pages_sparse(t: Tables) -> DataFrame:
    """The same pages under numbers with gaps, small ones and large."""
    spaced = F.col("page_no") * F.when(F.col("file_id") % 2 == 0, 10).otherwise(1_000_003)
    return attachments.join_pages(t.pages().withColumn("page_no", spaced))


@query("""
    SELECT CAST(p_partkey AS BIGINT) AS id, CAST(round(w * s) AS INTEGER) AS width, CAST(round(h * s) AS INTEGER) AS height
    FROM (SELECT *, CASE WHEN greatest(w, h) > 1280 THEN 1280.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS s
          FROM (SELECT p_partkey, CAST(p_size * 100 AS DOUBLE) AS w, CAST(p_partkey % 3000 + 1 AS DOUBLE) AS h FROM part))""")
def image_scale(t: Tables) -> DataFrame:
    width, height = text.scaled_size("width", "height")
    return t.images().select("id", width.alias("width"), height.alias("height"))


@query(f"""
    SELECT doc_id // 6 AS batch_id, doc_id % 6 AS pos, doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS name,
           md5(substring({trim('text')}, 1, 8000)) AS content
    FROM documents WHERE strlen(text) <= 4096""")
def uploaded_files(t: Tables) -> DataFrame:
    """All documents as files, written by tasks; those of the right size read, decoded, attached."""
    folder = run_folder(t.spark, "uploads")
    ending = F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt")
    uploads.write_files(t.raw("documents").select(F.concat(F.col("doc_id").cast("string"), ending).alias("name"), F.col("text").alias("content")), folder)
    read = uploads.read_uploads(t.spark, folder, 1 << 20).where("size <= 4096")
    ident = F.regexp_extract("name", "^([0-9]+)", 1).cast("long")
    files = read.select(
        F.expr("CAST(regexp_extract(name, '^([0-9]+)', 1) AS BIGINT) div 6").alias("batch_id"), (ident % 6).alias("pos"), "name",
        F.lit("").alias("mime"), "size", readers.decode_text("content").alias("text"), F.lit(0).alias("pending"))
    attached = attachments.ingest_attachments(files, max_bytes=4096).attached
    return attached.select("batch_id", "pos", "name", F.md5("content").alias("content"))


@query(f"""
    SELECT id AS request_id, pos, name, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS place
    FROM (SELECT a.request_id AS id, a.pos % 6 AS pos, a.name, row_number() OVER (PARTITION BY a.request_id ORDER BY a.pos) - 1 AS was
          FROM v_request_files a JOIN v_outgoing o ON o.id = a.request_id)
    WHERE was <> 1""")
def attachment_removed(t: Tables) -> DataFrame:
    """What is left of each request's files when the second one is taken out."""
    numbered = F.transform("attachments", lambda a, i: F.struct(i.cast("long").alias("pos"), a["name"].alias("name")))
    left = _outgoing(t).select("request_id", attachments.remove_attachment(numbered, 1).alias("left"))
    return explode_rows(left, "left", "place", "file").select(
        "request_id", F.col("file.pos").alias("pos"), F.col("file.name").alias("name"), F.col("place").cast("long").alias("place"))


# --- requests and responses ----------------------------------------------------------------------


def _outgoing(t: Tables) -> DataFrame:
    return prompts.outgoing_messages(t.drafts()).withColumnRenamed("id", "request_id")


@query("SELECT id AS request_id, message, shown FROM v_outgoing")
def outgoing_messages(t: Tables) -> DataFrame:
    return _outgoing(t).select("request_id", "message", "shown")


@query("""
    SELECT a.request_id, a.pos % 6 AS pos, a.type, a.name, a.dataUrl AS data_url
    FROM v_request_files a JOIN v_outgoing o ON o.id = a.request_id""")
def attachment_preview(t: Tables) -> DataFrame:
    preview = _outgoing(t).select("request_id", prompts.attachment_preview("attachments").alias("preview"))
    return explode_rows(preview, "preview", "pos", "a").select(
        "request_id", F.col("pos").cast("long").alias("pos"), "a.type", "a.name", F.col("a.dataUrl").alias("data_url")
    )


@query("""
    SELECT request_id, n_images > 0 AS is_vision,
           CASE WHEN n_images > 0 THEN 'meta-llama/llama-4-scout-17b-16e-instruct' ELSE 'llama-3.1-8b-instant' END AS model
    FROM v_requests""")
def model_route(t: Tables) -> DataFrame:
    return prompts.assemble_requests(_outgoing(t)).select("request_id", "is_vision", "model")


@query("SELECT request_id, user_text FROM v_requests")
def reference_block(t: Tables) -> DataFrame:
    """The user text of every request, read back from its body."""
    content = F.get_json_object("body", "$.messages[1].content")
    part = F.get_json_object("body", "$.messages[1].content[0].text")
    return prompts.assemble_requests(_outgoing(t)).select(
        "request_id", F.when(F.col("is_vision"), part).otherwise(content).alias("user_text")
    )


@query(f"""
    SELECT request_id, 2 AS n_messages, 'system' AS first_role, 'user' AS second_role,
           '{SYSTEM}' || CASE WHEN n_images > 0
               THEN ' If images are attached, describe what you can see and explain clearly.' ELSE '' END AS system_text,
           urls, CASE WHEN n_images > 0 THEN n_images + 1 ELSE 0 END AS n_parts,
           CAST(0.7 AS DOUBLE) AS temperature, 1024 AS max_tokens
    FROM v_requests""")
def request_fields(t: Tables) -> DataFrame:
    """Everything else in the body, read back from the JSON text."""
    parts = F.from_json(
        F.get_json_object("body", "$.messages[1].content"),
        T.ArrayType(T.StructType.fromDDL("type string, text string, image_url struct<url: string>")),
    )
    parts = F.when(F.col("is_vision"), parts)
    urls = F.transform(F.filter(parts, lambda p: p["type"] == "image_url"), lambda p: p["image_url"]["url"])
    return prompts.assemble_requests(_outgoing(t)).select(
        "request_id",
        F.json_array_length(F.get_json_object("body", "$.messages")).alias("n_messages"),
        F.get_json_object("body", "$.messages[0].role").alias("first_role"),
        F.get_json_object("body", "$.messages[1].role").alias("second_role"),
        F.get_json_object("body", "$.messages[0].content").alias("system_text"),
        F.coalesce(F.array_join(urls, " "), F.lit("")).alias("urls"),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_parts"),
        F.get_json_object("body", "$.temperature").cast("double").alias("temperature"),
        F.get_json_object("body", "$.max_tokens").cast("int").alias("max_tokens"),
    )


@query("SELECT request_id, names, n_images FROM v_requests")
def image_names(t: Tables) -> DataFrame:
    images = prompts.image_attachments("attachments")
    return _outgoing(t).select(
        "request_id", prompts.image_names(images).alias("names"), F.size(images).cast("long").alias("n_images")
    )


@query(f"""
    , sent AS (
        SELECT f.id AS request_id, e.pos, e.name, e.kind, e.content, e.data_url,
               row_number() OVER (PARTITION BY f.id, e.kind = 'image' ORDER BY e.pos) AS k
        FROM v_first_turns f JOIN v_examined e ON e.batch_id = f.session_id WHERE e.fault IS NULL),
    files AS (
        SELECT request_id, count(*) AS n, count(*) FILTER (kind = 'image' AND data_url <> '') AS n_images,
               string_agg('(' || k || ') ' || name || ':' || chr(10) || content, chr(10) || chr(10) ORDER BY k)
                   FILTER (kind <> 'image') AS block
        FROM sent GROUP BY request_id),
    asked AS (
        SELECT d.id AS request_id, COALESCE(f.n, 0) AS n, COALESCE(f.n_images, 0) AS n_images, f.block,
               {or_else(trim('d.text'), "'Please analyze the attached file(s) and summarize the key points clearly.'")} AS message
        FROM v_drafts d LEFT JOIN files f ON f.request_id = d.id WHERE {trim('d.text')} <> '' OR f.n > 0)
    SELECT a.request_id, n AS n_attachments, n_images,
           message || COALESCE(chr(10) || chr(10) || 'Attached references:' || chr(10) || block, '') AS user_text,
           CASE WHEN p.state IS NULL THEN 'pending' WHEN p.state = 'ok' THEN 'answer' WHEN p.state <> 'error' OR n_images = 0 THEN 'error'
                WHEN b.state IS NULL THEN 'fallback' WHEN b.state = 'ok' THEN 'answer' ELSE 'error' END AS outcome
    FROM asked a LEFT JOIN v_read p ON p.request_id = a.request_id AND p.attempt = 'primary'
    LEFT JOIN v_read b ON b.request_id = a.request_id AND b.attempt = 'fallback'""")
def attach_and_ask(t: Tables) -> DataFrame:
    """Files taken in, sent along with the first turn of a conversation, and answered."""
    attached = attachments.for_messages(attachments.ingest_attachments(t.files()).attached)
    first = t.drafts().groupBy("session_id").agg(F.min("id").alias("id"))
    of_turn = attached.withColumnRenamed("batch_id", "session_id").join(first, "session_id").select("id", "attachments")
    none = F.array().cast(of_turn.schema["attachments"].dataType)
    typed = t.drafts().drop("attachments").join(of_turn, "id", "left").withColumn("attachments", F.coalesce("attachments", none))
    outgoing = prompts.outgoing_messages(typed).withColumnRenamed("id", "request_id")
    requests = prompts.assemble_requests(outgoing).select(
        "request_id", "is_vision", F.get_json_object("body", "$.messages[1].content").alias("content"))
    outcomes = prompts.resolve_responses(outgoing, t.responses()).select("request_id", "outcome")
    images = F.size(prompts.image_attachments("attachments")).cast("long").alias("n_images")
    counted = outgoing.select("request_id", F.size("attachments").cast("long").alias("n_attachments"), images)
    user_text = F.when(F.col("is_vision"), F.get_json_object("content", "$[0].text")).otherwise(F.col("content"))
    return counted.join(requests, "request_id").join(outcomes, "request_id").select(
        "request_id", "n_attachments", "n_images", user_text.alias("user_text"), "outcome")


@query("SELECT request_id, outcome, text FROM v_outcomes")
def resolve_responses(t: Tables) -> DataFrame:
    return prompts.resolve_responses(_outgoing(t), t.responses())


@query("""
    SELECT r.request_id, 'llama-3.1-8b-instant' AS model,
           r.user_text || chr(10) || chr(10) || 'Image attachments: ' || r.names AS user_text
    FROM v_requests r JOIN v_read p ON p.request_id = r.request_id AND p.attempt = 'primary'
    WHERE r.n_images > 0 AND p.state = 'error'""")
def fallback_requests(t: Tables) -> DataFrame:
    return prompts.fallback_requests(_outgoing(t), t.responses()).select(
        "request_id", "model", F.get_json_object("body", "$.messages[1].content").alias("user_text")
    )


@query("""
    SELECT id, CAST(session_id AS VARCHAR) AS session, role, content FROM v_incoming""")
def parse_save_payload(t: Tables) -> DataFrame:
    """Messages written as bodies of a save call and parsed again."""
    bodies = t.incoming().select("id", F.to_json(F.struct(
        F.col("session_id").cast("string").alias("sessionId"), "role", "content")).alias("body"))
    parsed = bodies.select("id", readers.parse_payload("body", schemas.SAVE_PAYLOAD).alias("p"))
    return parsed.select("id", F.col("p.sessionId").alias("session"), "p.role", "p.content")


@query("""
    SELECT request_id, title, CAST(update_id AS VARCHAR) AS update_id FROM v_session_requests""")
def parse_session_payload(t: Tables) -> DataFrame:
    """Session requests as bodies; a field that is not there is NULL."""
    bodies = t.session_requests().select("request_id", F.to_json(F.struct(
        "title", F.col("update_id").cast("string").alias("updateId"))).alias("body"))
    parsed = bodies.select("request_id", readers.parse_payload("body", schemas.SESSION_PAYLOAD).alias("p"))
    return parsed.select("request_id", "p.title", F.col("p.updateId").alias("update_id"))


@query("""
    SELECT request_id, CASE WHEN user_id IS NULL THEN 401 ELSE 400 END AS status,
           CASE WHEN user_id IS NULL THEN 'Unauthorized' ELSE 'Session ID is required' END AS reason
    FROM v_session_requests WHERE user_id IS NULL OR update_id IS NULL""")
def rejected_deletes(t: Tables) -> DataFrame:
    asked = t.session_requests().withColumnRenamed("update_id", "session_id")
    _, rejected = ingest.check_deletes(asked)
    return rejected


@query("""
    SELECT id AS request_id, 400 AS status, 'Message is required' AS reason
    FROM v_messages WHERE role = 'user' AND id % 7 = 0""")
def invalid_requests(t: Tables) -> DataFrame:
    """Calls whose message is empty or missing."""
    turns = t.messages().where(F.col("role") == "user")
    blank = F.when(F.col("id") % 14 == 0, F.lit("")).when(F.col("id") % 7 != 0, F.lit("x"))
    return prompts.invalid_requests(turns.select(F.col("id").alias("request_id"), blank.alias("message")))


@query("""
    SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN text || chr(65533) WHEN 2 THEN chr(65533) || 'A' || text ELSE text END AS text
    FROM documents""")
def decode_text(t: Tables) -> DataFrame:
    """Bytes of documents with a byte order mark, a stray byte at the end, or a cut sequence."""
    content = F.encode("text", "UTF-8")
    damaged = pick(F.col("doc_id"), 3, {
        0: F.concat(F.unhex(F.lit("EFBBBF")), content), 1: F.concat(content, F.unhex(F.lit("FF"))),
    }, F.concat(F.unhex(F.lit("C341")), content))
    return t.raw("documents").select("doc_id", readers.decode_text(damaged).alias("text"))


@query("SELECT id AS request_id, message, n_files AS n_attachments FROM v_outgoing")
def parse_payload(t: Tables) -> DataFrame:
    """Requests written as call bodies and parsed again; no attachments, no such field."""
    sent = F.when(F.size("attachments") > 0, F.col("attachments"))
    bodies = _outgoing(t).select("request_id", F.to_json(F.struct("message", sent.alias("attachments"))).alias("body"))
    return bodies.select("request_id", readers.parse_ask("body").alias("p")).select(
        "request_id", "p.message", F.size("p.attachments").cast("long").alias("n_attachments")
    )


@query(f"""
    SELECT d.session_id, {title('base')} AS title
    FROM (SELECT o.session_id, o.id,
                 COALESCE(NULLIF({trim('o.text')}, ''), 'File: ' || NULLIF(a.name, ''), 'New chat') AS base,
                 row_number() OVER (PARTITION BY o.session_id ORDER BY o.created_at, o.id) AS k
          FROM v_outgoing o LEFT JOIN v_first_names a ON a.request_id = o.id) d
    JOIN v_outcomes r ON r.request_id = d.id AND r.outcome = 'answer'
    WHERE d.k = 1""")
def session_titles(t: Tables) -> DataFrame:
    outgoing = _outgoing(t)
    outcomes = prompts.resolve_responses(outgoing, t.responses()).select("request_id", "outcome")
    drafts = outgoing.join(outcomes, "request_id", "left").withColumnRenamed("request_id", "id")
    return sessions.title_sessions(drafts)


# --- replies --------------------------------------------------------------------------------------


@query("SELECT id, length(content) > 680 AS is_long FROM v_messages")
def long_reply(t: Tables) -> DataFrame:
    return t.messages().select("id", text.is_long_reply("content").alias("is_long"))


@query("""
    SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY line_no) - 1 AS line_no, is_list, item AS text
    FROM v_lines""")
def reply_lines(t: Tables) -> DataFrame:
    lined = t.replies().select(F.col("id").alias("message_id"), reply_functions.classified_lines("content").alias("lines"))
    return explode_rows(lined, "lines", "line_no", "l").select(
        "message_id", F.col("line_no").cast("long").alias("line_no"), "l.is_list", "l.text"
    )


@query("""
    SELECT message_id, CAST(block_no AS BIGINT) AS block_no, kind, count(*) AS n_items,
           string_agg(text, chr(10) ORDER BY item_no) AS items
    FROM v_items GROUP BY message_id, block_no, kind""")
def reply_blocks(t: Tables) -> DataFrame:
    return replies.structure_replies(t.replies()).blocks.select(
        "message_id", F.col("block_no").cast("long").alias("block_no"), "kind",
        F.size("items").cast("long").alias("n_items"), F.array_join("items", "\n").alias("items"),
    )


@query("""
    SELECT message_id, CAST(block_no AS BIGINT) AS block_no, kind, CAST(item_no AS BIGINT) AS item_no, text FROM v_items""")
def reply_items(t: Tables) -> DataFrame:
    items = replies.block_items(replies.reply_blocks(t.replies()))
    return items.select(
        "message_id", F.col("block_no").cast("long").alias("block_no"), "kind",
        F.col("item_no").cast("long").alias("item_no"), "text",
    )


@query(r"""
    SELECT message_id, CAST(block_no AS BIGINT) AS block_no, CAST(item_no AS BIGINT) AS item_no,
           CAST(generate_subscripts(terms, 1) - 1 AS BIGINT) AS pos, unnest(terms) AS term
    FROM (SELECT *, regexp_extract_all(text, '\*\*([^*]+)\*\*', 1) AS terms FROM v_items)""")
def reply_bold(t: Tables) -> DataFrame:
    bold = replies.structure_replies(t.replies()).bold
    return bold.withColumns({c: F.col(c).cast("long") for c in ("block_no", "item_no", "pos")})


@query(r"""
    SELECT doc_id, CAST(generate_subscripts(terms, 1) - 1 AS BIGINT) AS pos, unnest(terms) AS term
    FROM (SELECT doc_id, regexp_extract_all(text, '\*\*([^*]+)\*\*', 1) AS terms FROM documents)""")
def bold_terms(t: Tables) -> DataFrame:
    terms = t.raw("documents").select("doc_id", text.bold_terms("text").alias("terms"))
    return explode_rows(terms, "terms", "pos", "term").withColumn("pos", F.col("pos").cast("long"))


@query(r"""
    SELECT doc_id, count(*) AS n_spans, count(*) FILTER (part % 2 = 0) AS n_bold,
           string_agg(CASE WHEN part % 2 = 0 THEN '<b>' || piece || '</b>' ELSE piece END, '' ORDER BY part) AS marked
    FROM (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS part
          FROM (SELECT doc_id, string_split(regexp_replace(text, '\*\*([^*]+)\*\*', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS pieces
                FROM documents))
    GROUP BY doc_id""")
def inline_spans(t: Tables) -> DataFrame:
    spans = t.raw("documents").select("doc_id", text.inline_spans("text").alias("spans"))
    marked = F.transform(
        "spans", lambda s: F.when(s["bold"], F.concat(F.lit("<b>"), s["text"], F.lit("</b>"))).otherwise(s["text"])
    )
    return spans.select(
        "doc_id", F.size("spans").cast("long").alias("n_spans"),
        F.size(F.filter("spans", lambda s: s["bold"])).cast("long").alias("n_bold"),
        F.array_join(marked, "").alias("marked"),
    )


# --- throttle -------------------------------------------------------------------------------------


def _throttle_sql(interval_us: int) -> str:
    return f"""
        , walk AS (
            SELECT event_id, user_id, force, n, us AS clock, true AS passed FROM v_events WHERE n = 1
            UNION ALL
            SELECT e.event_id, e.user_id, e.force, e.n,
                   CASE WHEN e.force OR e.us - w.clock >= {interval_us} THEN e.us ELSE w.clock END,
                   e.force OR e.us - w.clock >= {interval_us}
            FROM walk w JOIN v_events e ON e.user_id = w.user_id AND e.n = w.n + 1)
        SELECT event_id, user_id, force FROM walk WHERE passed"""


def _throttled(t: Tables, interval_ms: int) -> DataFrame:
    return throttle.throttle_events(t.refresh_events(), interval_ms).select("event_id", "user_id", "force")


@query(_throttle_sql(15_000_000))
def throttle_events(t: Tables) -> DataFrame:
    return _throttled(t, throttle.INTERVAL_MS)


@query(_throttle_sql(12 * 3600 * 1_000_000))
def throttle_events_12h(t: Tables) -> DataFrame:
    """A long interval, so that most events of the test table are held back."""
    return _throttled(t, 12 * 3600 * 1000)


# --- streams --------------------------------------------------------------------------------------


def _arrivals(df: DataFrame, path: str, order: str, slices: int = 4) -> Iterator[None]:
    """Add ``df`` to ``path`` in slices that arrive one after another, cut by equal widths of
    ``order``; each is written by as many tasks as ``df`` has partitions."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    for k in range(slices):
        first, behind = (low + (high - low) * x / slices for x in (k, k + 1))
        part = (F.col(order) >= F.lit(first)) & (F.lit(k == slices - 1) | (F.col(order) < F.lit(behind)))
        yield df.where(part).write.mode("append").parquet(path)


def _ingested_stream(t: Tables) -> tuple[str, str]:
    """Save all incoming messages as a stream of eight batches.  In each of the first seven some
    messages come twice, the second time later and with another text; the last batch sends
    some of all again.  Returns the folders of the sessions and the output.

    The stream is started anew for every arrival, so a batch is one, however many files it has.
    """
    out = run_folder(t.spark, "ingest")
    messages.write_sessions(t.sessions(), f"{out}/chat_sessions")

    def arrive() -> None:
        incoming = readers.stream_table(t.spark, f"{out}/incoming", "incoming_messages")
        messages.ingest_stream(
            incoming, f"{out}/chat_sessions", f"{out}/saved", f"{out}/checkpoint", now=now()
        ).awaitTermination()

    again = t.incoming().where("id % 7 = 0").withColumns({
        "content": F.when(F.col("content") != "", F.concat("content", F.lit(" (sent again)"))).otherwise(F.col("content")),
        "created_at": F.col("created_at") + F.expr("INTERVAL 30 SECONDS"),
    })
    for _ in _arrivals(t.incoming().unionByName(again), f"{out}/incoming", "created_at", slices=7):
        arrive()
    t.incoming().where("id % 5 = 0 AND user_id IS NOT NULL").write.mode("append").parquet(f"{out}/incoming")
    arrive()
    return f"{out}/chat_sessions", f"{out}/saved"


@query(f"""
    SELECT id, session_id, user_id, role, content, {stamp('created_at')} AS created_at FROM v_status WHERE status = 200""")
def ingest_stream(t: Tables) -> DataFrame:
    _, saved = _ingested_stream(t)
    return timed(messages.saved_messages(t.spark, saved), "created_at")


@query(f"""
    SELECT s.id, {stamp('greatest(s.updated_at, max(m.created_at))')} AS updated_at
    FROM v_sessions s LEFT JOIN v_status m ON m.session_id = s.id AND m.status = 200 GROUP BY s.id, s.updated_at""")
def ingest_stream_sessions(t: Tables) -> DataFrame:
    sessions_path, saved = _ingested_stream(t)
    return timed(messages.current_sessions(t.spark, sessions_path, saved), "updated_at").select("id", "updated_at")


def _paired_stream(t: Tables) -> str:
    """Requests and responses as two streams, each in four arrivals of equal time; then what
    comes a day and two days later lets the last requests time out and come out."""
    out = run_folder(t.spark, "pairing")
    sent = _outgoing(t).select("request_id", "message", "attachments", F.col("created_at").alias("sent_at"))
    # Stored, since every arrival takes its part of them.
    sent, received = stored(sent, "pairing-sent"), stored(t.received_responses(), "pairing-received")
    low, high = sent.agg(F.min("sent_at"), F.max("sent_at")).first()
    streams_of = {"sent_requests": (sent, "sent_at"), "received_responses": (received, "received_at")}

    def arrive() -> None:
        requests, answers = (readers.stream_table(t.spark, f"{out}/{name}", name) for name in streams_of)
        pairing.resolve_stream(requests, answers, f"{out}/outcomes", f"{out}/checkpoint").awaitTermination()

    for k in range(4):
        first, behind = (low + (high - low) * x / 4 for x in (k, k + 1))
        for name, (rows, at) in streams_of.items():
            part = (F.col(at) >= F.lit(first)) & (F.lit(k == 3) | (F.col(at) < F.lit(behind)))
            rows.where(part).write.mode("append").parquet(f"{out}/{name}")
        arrive()
    for days in (1, 2):
        for name, (_, at) in streams_of.items():
            # Rows of nobody's, which pair with nothing.
            row = {f.name: F.lit(None).cast(f.dataType) for f in schemas.TABLES[name]}
            row |= {"request_id": F.lit(-days if at == "sent_at" else -10).cast("long"),
                    at: F.lit(high).cast("timestamp") + F.expr(f"INTERVAL {days} DAY")}
            row |= {"message": F.lit("later")} if at == "sent_at" else {"attempt": F.lit("primary"), "body": F.lit("{}")}
            t.spark.range(1).select(*(c.alias(n) for n, c in row.items())).write.mode("append").parquet(f"{out}/{name}")
        arrive()
    return f"{out}/outcomes"


@query("""
    SELECT request_id,
           CASE WHEN again AND f_state IS NULL THEN 'fallback'
                WHEN again THEN CASE WHEN f_state = 'ok' THEN 'answer' ELSE 'error' END
                WHEN p_state IS NULL THEN 'pending'
                WHEN p_state = 'ok' THEN 'answer' ELSE 'error' END AS outcome,
           CASE WHEN again THEN f_text ELSE p_text END AS text
    FROM (SELECT r.request_id, p.state AS p_state, p.text AS p_text, f.state AS f_state, f.text AS f_text,
                 r.n_images > 0 AND COALESCE(p.state, '') = 'error' AS again
          FROM v_requests r
          LEFT JOIN v_read p ON p.request_id = r.request_id AND p.attempt = 'primary' AND r.request_id % 7 <> 0
          LEFT JOIN v_read f ON f.request_id = r.request_id AND f.attempt = 'fallback' AND r.request_id % 13 <> 0)""")
def resolve_stream(t: Tables) -> DataFrame:
    """Responses that are late by more than the time-out do not count, nor second ones."""
    return pairing.outcomes_so_far(t.spark, _paired_stream(t)).where("request_id >= 0")


def _throttled_stream(t: Tables) -> str:
    """All events as a stream of several batches, one for every arrival, with a delay."""
    out = run_folder(t.spark, "throttle")
    for _ in _arrivals(t.refresh_events(), f"{out}/events", "ts"):
        events = readers.stream_table(t.spark, f"{out}/events", "refresh_events")
        streams.throttle_stream(events, out, f"{out}/checkpoint", 12 * 3600 * 1000, delay_ms=3_600_000).awaitTermination()
    return out


@query(_throttle_sql(12 * 3600 * 1_000_000))
def throttle_stream(t: Tables) -> DataFrame:
    out = _throttled_stream(t)
    streams.finish(t.spark, out, 12 * 3600 * 1000)
    return streams.passed_events(t.spark, out).select("event_id", "user_id", "force")


@query("""
    SELECT event_id, user_id FROM v_events WHERE us > (SELECT max(us) FROM v_events) - 3600000000""")
def throttle_stream_waiting(t: Tables) -> DataFrame:
    """What still waits at the end of the stream: the events of the last hour."""
    return streams.waiting_events(t.spark, _throttled_stream(t)).select("event_id", "user_id")


@query(_throttle_sql(12 * 3600 * 1_000_000))
def throttle_keyed(t: Tables) -> DataFrame:
    """All events through the state store, stopped and started again from its checkpoint between
    arrivals; an event of nobody's, long after the others, moves the watermark past them."""
    out = run_folder(t.spark, "throttle-keyed")

    def arrive() -> None:
        events = readers.stream_table(t.spark, f"{out}/events", "refresh_events")
        streams.keyed_throttle(events, 12 * 3600 * 1000, "1 hour", 3_600_000).writeStream.format("parquet").option(
            "path", f"{out}/passed").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for _ in _arrivals(t.refresh_events(), f"{out}/events", "ts"):
        arrive()
    high = t.refresh_events().agg(F.max("ts")).first()[0]
    later = F.lit(high).cast("timestamp") + F.expr("INTERVAL 7 DAYS")
    t.spark.range(1).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), later.alias("ts"), F.lit(False).alias("force"),
    ).write.mode("append").parquet(f"{out}/events")
    arrive()
    return t.spark.read.schema(streams.EVENTS).parquet(f"{out}/passed").where("user_id >= 0").select("event_id", "user_id", "force")
