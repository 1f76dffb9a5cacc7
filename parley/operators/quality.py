"""Constraint checks: one violation row per broken key.

Every table is read once.  Each of its rows says which keys it holds, and in which column, or
that it is a violation by itself.  Columns that refer to each other share their keys, so one
row of the aggregate tells for a key how many rows of each column hold it, and with that all
unique and foreign keys it takes part in.  The aggregate settles all constraints at once; it
combines map-side, so a key that holds a third of a table is one row per task in the shuffle.
A task keeps its keys meanwhile, most of them unique: a number stands for the constraint.

The marks are counted, so the report can also be kept up to date: signed counts of the rows
that came and went are added, and what they tell is read off (``apply_to_counts``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The declared constraints.
NOT_NULL = {
    "profiles": ["email", "created_at", "updated_at"],
    "chat_sessions": ["user_id", "created_at", "updated_at"],
    "chat_messages": ["session_id", "user_id", "role", "content", "created_at"],
}
UNIQUE = {"profiles": ["id", "email"], "chat_sessions": ["id"], "chat_messages": ["id"]}
FOREIGN = [
    ("chat_sessions", "user_id", "profiles"),
    ("chat_messages", "user_id", "profiles"),
    ("chat_messages", "session_id", "chat_sessions"),
    ("profiles", "id", "signups"),
]
ROLES = ["user", "assistant"]


def _report(df: DataFrame, table: str, constraint: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(table).alias("table"),
        F.lit(constraint).alias("constraint"),
        key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def null_violations(df: DataFrame, table: str) -> DataFrame:
    """One row per NULL in a NOT NULL column, found in a single scan."""
    broken = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in NOT_NULL[table]])
    )
    return (
        df.select("id", F.explode(broken).alias("column"))
        .select(
            F.lit(table).alias("table"),
            F.concat(F.lit("not_null:"), "column").alias("constraint"),
            F.col("id").cast("string").alias("key"),
            F.lit("is null").alias("detail"),
        )
    )


def duplicate_keys(df: DataFrame, table: str, column: str) -> DataFrame:
    """Non-NULL values that occur more than once."""
    many = df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1")
    return _report(many, table, f"unique:{column}", F.col(column), F.col("count"))


def _domains(tables: set[str]) -> list[list[tuple[str, str]]]:
    """The columns (table, column) that hold keys, those that share their keys together."""
    found = [{(table, column)} for table in sorted(tables) for column in UNIQUE.get(table, [])]
    for child, column, parent in FOREIGN:
        if {child, parent} <= tables:
            ends = {(child, column), (parent, "id")}
            met = [d for d in found if d & ends]
            found = [d for d in found if not d & ends] + [ends.union(*met)]
    return [sorted(d) for d in sorted(found, key=min)]


def _itself(table: str) -> list[tuple[str, Column, Column]]:
    """What a row of ``table`` can break by itself: constraint, when, detail."""
    found = [(f"not_null:{c}", F.col(c).isNull(), F.lit("is null")) for c in NOT_NULL.get(table, [])]
    if table == "chat_messages":
        found.append(("check:role", ~F.col("role").isin(ROLES), F.col("role")))
    return found


def _mark(code: int, key: str, column: int = 0, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.col(key).cast("string").alias("key"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"), F.lit(column).alias("column"))


def _marks(df: DataFrame, table: str, domains: list, alone: list) -> DataFrame:
    """A row per key that a row of ``table`` holds, and per constraint it breaks by itself."""
    marks = [
        F.when(F.col(c).isNotNull(), _mark(code, c, k))
        for code, domain in enumerate(domains) for k, (of, c) in enumerate(domain) if of == table]
    marks += [
        F.when(broken, _mark(len(domains) + alone.index((table, name)), "id", detail=detail))
        for name, broken, detail in _itself(table)]
    return df.select("sign", F.explode(F.array_compact(F.array(*marks))).alias("m")).select("sign", "m.*")


def _told(domains: list, alone: list, tables: set[str]) -> Column:
    """Per row of (code, key, detail, n0, n1, ...): what it tells of each constraint."""
    def told(code: int, table: str, constraint: str, n: Column, parents: Column = F.lit(0).cast("long")) -> Column:
        row = F.struct(
            F.lit(table).alias("table"), F.lit(constraint).alias("constraint"), "key", "detail", n.alias("n"), parents.alias("parents"))
        return F.when((F.col("code") == code) & ((n != 0) | (parents != 0)), row)

    found = [told(len(domains) + k, table, name, F.col("n0")) for k, (table, name) in enumerate(alone)]
    for code, domain in enumerate(domains):
        n = {at: F.col(f"n{k}") for k, at in enumerate(domain)}
        found += [told(code, t, f"unique:{c}", n[t, c]) for t, c in domain if c in UNIQUE.get(t, [])]
        found += [
            told(code, child, f"foreign_key:{column}->{parent}", n[child, column], n[parent, "id"])
            for child, column, parent in FOREIGN if {child, parent} <= tables and (child, column) in n]
    return F.array_compact(F.array(*found))


def not_exactly_one(df: DataFrame, wanted: DataFrame, key: str, at_most: bool = False) -> DataFrame:
    """(key, count) of wanted keys that break the "single row" contract.

    ``at_most`` accepts a missing row as well.  Rows are never silently limited to one.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    keyed = wanted.select(key).distinct().join(counts, key, "left")
    n = F.coalesce("n", F.lit(0))
    return keyed.select(key, n.alias("n")).where(F.col("n") > 1 if at_most else F.col("n") != 1)


def orphans(child: DataFrame, table: str, column: str, parent: DataFrame, parent_table: str) -> DataFrame:
    """Child keys without a parent row, with the number of rows that hold each."""
    keys = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    lost = keys.join(parent.select(F.col("id").alias(column)), column, "left_anti")
    return _report(lost, table, f"foreign_key:{column}->{parent_table}", F.col(column), F.col("n"))


def bad_roles(messages: DataFrame) -> DataFrame:
    bad = messages.where(~F.col("role").isin(ROLES))
    return _report(bad, "chat_messages", "check:role", F.col("id"), F.col("role"))


def check_constraints(
    profiles: DataFrame,
    sessions: DataFrame,
    messages: DataFrame,
    signups: DataFrame | None = None,
) -> DataFrame:
    """Violation report (table, constraint, key, detail) over the whole model."""
    tables = {"profiles": profiles, "chat_sessions": sessions, "chat_messages": messages}
    if signups is not None:
        tables["signups"] = signups
    return violations(constraint_counts(tables))


_KEYS = ["table", "constraint", "key", "detail"]


def constraint_counts(tables: dict[str, DataFrame], all_tables: set[str] | None = None) -> DataFrame:
    """(table, constraint, key, detail, n, parents): how many rows hold each key of each
    constraint, and how many are there to refer to.

    A frame with a ``sign`` holds changes: rows that came (1) and that went (-1).  A changed
    row has gone as it was and come as it is.  ``all_tables`` names the tables of the model
    where ``tables`` are only some of them.
    """
    names = all_tables or set(tables)
    domains, alone = _domains(names), [(t, constraint) for t in sorted(names) for constraint, _, _ in _itself(t)]

    def marked(df: DataFrame, name: str) -> DataFrame:
        signed = df if "sign" in df.columns else df.withColumn("sign", F.lit(1))
        return _marks(signed, name, domains, alone)

    marks = reduce(DataFrame.unionByName, [marked(df, name) for name, df in tables.items()])
    sign = F.col("sign").cast("long")
    held = marks.groupBy("code", "key", "detail").agg(*(
        F.sum(F.when(F.col("column") == k, sign).otherwise(0)).alias(f"n{k}") for k in range(max(map(len, domains)))))
    return held.select(F.explode(_told(domains, alone, names)).alias("told")).select("told.*")


def apply_to_counts(counts: DataFrame, changes: dict[str, DataFrame], all_tables: set[str]) -> DataFrame:
    """The counts after signed ``changes`` of some tables; the tables themselves are not read."""
    delta = constraint_counts(changes, all_tables)
    return counts.unionByName(delta).groupBy(*_KEYS).agg(
        F.sum("n").alias("n"), F.sum("parents").alias("parents")).where("n <> 0 OR parents <> 0")


def violations(counts: DataFrame) -> DataFrame:
    """The violation report (table, constraint, key, detail) that the counts tell."""
    # What is wrong by itself is reported row by row, the rest once per key with its rows.
    itself = F.col("detail").isNotNull()
    broken = F.when(itself, F.col("n") > 0).when(F.col("constraint").startswith("unique"), F.col("n") > 1).otherwise(
        (F.col("parents") <= 0) & (F.col("n") > 0))
    times = F.when(itself, F.col("n")).otherwise(F.lit(1)).cast("int")
    return counts.where(broken).select(
        "table", "constraint", "key", F.coalesce("detail", F.col("n").cast("string")).alias("detail"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("one"),
    ).drop("one")
