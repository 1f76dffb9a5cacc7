"""Connected components of a growing set of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm.shared import BROADCAST_ROWS, small, written


def _jump(parent: DataFrame, light: bool) -> DataFrame:
    """Follow every parent to its root, doubling the step each time."""
    while True:
        up = _side(parent.select(F.col("u").alias("p"), F.col("p").alias("pp")), light)
        parent = written(parent.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "components")
        moved = not parent.where("moved").isEmpty()
        parent = parent.drop("moved")
        if not moved:
            return parent


def _side(df: DataFrame, light: bool) -> DataFrame:
    return F.broadcast(df) if light else df


def components(links: DataFrame) -> DataFrame:
    """(u, label) for every end of a link (a, b): the least end reachable.

    Each round points every node at its least neighbour, follows the pointers to their
    roots, and replaces the links by links between roots.  Roots are local minima, so at
    least half of the nodes with links vanish in a round.
    """
    links = written(links.select("a", "b"), "components")
    # Links join two nodes each, so tables of nodes are twice as long at most.
    light = links.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = _jump(written(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("v")).select(
            "u", F.least("u", "v").alias("p")), "components"), light)
        if found is None:
            found = parent.withColumnRenamed("p", "label")
        else:
            moved = _side(parent.withColumnRenamed("u", "label"), light)
            found = written(found.join(moved, "label", "left").select(
                "u", F.coalesce("p", "label").alias("label")), "components")
        to_a, to_b = (_side(parent.select(F.col("u").alias(x), F.col("p").alias(f"p{x}")), light) for x in "ab")
        roots = links.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        links = written(roots.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "components")
    return found


class Labels:
    """Which group each document is in so far; documents without links are their own."""

    def __init__(self, spark: SparkSession):
        self.table: DataFrame | None = None
        self.known: DataFrame | None = None
        self.spark = spark

    def attach(self, rows: DataFrame, key: str) -> DataFrame:
        rows = rows.drop("label")
        if self.table is None:
            return rows.withColumn("label", F.col(key))
        known = self.known.withColumnRenamed("u", key)
        return rows.join(known, key, "left").withColumn("label", F.coalesce("label", key))

    def link(self, links: DataFrame) -> None:
        """Merge the groups that links (a, b) join; a label is the least document."""
        if links.isEmpty():
            return
        if self.table is None:
            self._set(components(links))
            return
        ends = links.select("a", "b")
        for end in "ab":
            ends = self.attach(ends, end).drop(end).withColumnRenamed("label", end)
        new = components(ends.where("a <> b").distinct())
        if new is None:
            return
        renamed = new.select(F.col("u").alias("label"), F.col("label").alias("to"))
        old = self.table.join(renamed, "label", "left").select("u", F.coalesce("to", "label").alias("label"))
        fresh = new.join(self.table.select("u"), "u", "left_anti")
        self._set(written(old.unionByName(fresh), "components"))

    def _set(self, table: DataFrame) -> None:
        self.table, self.known = table, small(table)
