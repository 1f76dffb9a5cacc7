"""Row-level access: who may read or change which rows of which table.

A user sees and changes only rows they own.  A command without a policy is denied for
everyone.  The owner is a plain column of every table, so access is a filter, never a
look-up of the parent row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Owner column and the commands that have a policy.
OWNER = {"profiles": "id", "chat_sessions": "user_id", "chat_messages": "user_id"}
POLICIES = {
    "profiles": {"select", "insert", "update"},
    "chat_sessions": {"select", "insert", "update", "delete"},
    "chat_messages": {"select", "insert"},
}


def allowed(table: str, command: str, uid) -> Column:
    """Predicate of the policy; ``uid`` is a value or a Column holding the caller."""
    if command not in POLICIES[table]:
        return F.lit(False)
    uid = uid if isinstance(uid, Column) else F.lit(uid)
    # A caller without an identity matches nothing, rather than UNKNOWN.
    return F.coalesce(F.col(OWNER[table]) == uid, F.lit(False))


def visible(df: DataFrame, table: str, uid, command: str = "select") -> DataFrame:
    """The rows of ``df`` the caller may touch with ``command``.

    ``uid`` is one identity, or a frame (uid, table) of granted callers for bulk work.
    """
    if not isinstance(uid, DataFrame):
        owner = OWNER[table]
        if command not in POLICIES[table]:
            return df.where(F.lit(False))
        # Written without a coalesce so that it can reach the Parquet scan.
        return df.where(F.col(owner) == F.lit(uid))
    if command not in POLICIES[table]:
        return df.where(F.lit(False))
    callers = uid.where(F.col("table") == table).select(F.col("uid").alias(OWNER[table]))
    return df.join(callers, OWNER[table], "left_semi").select(*df.columns)


def check_writes(df: DataFrame, table: str, command: str, uid: str = "uid") -> tuple[DataFrame, DataFrame]:
    """Split rows to be written into (accepted, rejected) by the same predicate.

    ``uid`` names the column with the identity of the writer.
    """
    mine = allowed(table, command, F.col(uid))
    return df.where(mine), df.where(~mine)


COMMANDS = ("select", "insert", "update", "delete")
CALLER = "caller_id"


def install_policies(spark: SparkSession, tables: dict[str, DataFrame], identity: str = "BIGINT") -> None:
    """The policies for SQL: who asks is a session variable, what they may touch are views.

    Declares ``caller_id`` (nobody at first), the function ``may(table, command, owner)`` for
    write checks, and for every table and command a view ``<table>_for_<command>`` of the rows
    the caller may touch.  A view's predicate is a plain comparison with the variable, so its
    value reaches the scan.
    """
    spark.sql(f"DECLARE OR REPLACE VARIABLE {CALLER} {identity} DEFAULT NULL")
    granted = " OR ".join(
        f"(t = '{table}' AND c IN ({', '.join(repr(c) for c in COMMANDS if c in commands)}))"
        for table, commands in POLICIES.items()
    )
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION may(t STRING, c STRING, owner {identity}, caller {identity}) RETURNS BOOLEAN
        RETURN COALESCE(({granted}) AND owner = caller, false)""")
    for table, rows in tables.items():
        rows.createOrReplaceTempView(f"all_{table}")
        for command in COMMANDS:
            holds = f"{OWNER[table]} = {CALLER}" if command in POLICIES[table] else "false"
            spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {table}_for_{command} AS SELECT * FROM all_{table} WHERE {holds}")


def as_caller(spark: SparkSession, uid) -> None:
    """From here on the session's SQL asks for ``uid``."""
    spark.sql(f"SET VARIABLE {CALLER} = :uid", {"uid": uid})
