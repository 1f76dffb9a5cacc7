"""Join of a fact table with per-key aggregates of it, when single keys may hold much of it.

AQE splits a hot partition only where both join inputs come straight out of a shuffle and
nothing above the join relies on its partitioning.  A side that is itself an aggregate does
not, so the split is written into the plan here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def salted_keys(summary: DataFrame, key: str, partitions: int) -> DataFrame:
    """The heavy keys of ``summary`` and how many ``salts`` each gets.

    A key is heavy when it holds more rows than an even share of one partition.  There are
    fewer such keys than partitions, whatever the size of the table, and a key gets a salt
    for every such share it holds, so a salted key never holds much more than one.
    """
    fair = F.lit(summary.agg(F.sum("n")).scalar()) / partitions
    salts = F.ceil(F.col("n") / fair).cast("int")
    return summary.where(F.col("n") > fair).select(key, salts.alias("salts"))


def spread_join(
    facts: DataFrame,
    summary: DataFrame,
    key: str,
    spread_by: list[str],
    partitions: int | None = None,
) -> DataFrame:
    """Inner join of ``facts`` with ``summary``, one row per key with its row count ``n``.

    The facts of heavy keys are dealt over salted join keys by a hash of ``spread_by`` (a
    recomputed task deals them the same way) and only their summary rows are repeated.
    The heavy keys are broadcast: there are fewer than ``partitions`` of them, by default
    the session's shuffle partitions.
    """
    partitions = partitions or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(salted_keys(summary, key, partitions))
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.col("salts"))).otherwise(0)
    dealt = facts.join(heavy, key, "left").withColumn("salt", salt.cast("int")).drop("salts")
    every = F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)
    repeated = summary.join(heavy, key, "left").withColumn("salt", F.explode(every)).drop("salts", "n")
    return dealt.join(repeated, [key, "salt"]).drop("salt")
