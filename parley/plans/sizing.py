"""Numbers of partitions and salts that follow the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

PARTITION_BYTES = 128 << 20


def partitions_for(df: DataFrame, partition_bytes: int = PARTITION_BYTES, grown: float = 1.0) -> int:
    """Partitions for a shuffle of ``df``: its size by the planner's estimate, times
    ``grown``, over the wanted bytes of each, and never less than the session's number.

    The estimate comes from file sizes, so nothing is read for it.  Without one (the planner
    then assumes far more than any table holds) the session's number stays.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 62:
        return least
    return max(least, -(-int(size * grown) // partition_bytes))
