"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Planner settings the operators are written against.  All are runtime settings, so they
# can be applied to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot session or user shows up as one oversized shuffle partition of a join; AQE
    # splits the fact side of that partition and re-reads the small side for each split.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A look-up of some keys reaches the Parquet reader as such (``plans.buckets.PUSHED``).
    "spark.sql.parquet.pushdown.inFilterThreshold": "200",
}


def build_session(app_name: str = "parley", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int, partition_bytes: int = 256 << 20) -> int:
    """Set the number of shuffle partitions for a job over ``input_bytes``.

    The number AQE starts from is an upper bound it can only merge down, so it has to grow
    with the data: with the default of 200, a shuffle of 100 TB would have 500 GB in each
    partition.  The configured number is kept as the minimum.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(least, -(-input_bytes // partition_bytes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return wanted


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none (a test run) gets a folder of its own.  On a
    cluster it must be a shared folder: streaming state and written tables have to survive
    the loss of any machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return _local_folder(spark.sparkContext.applicationId)


@lru_cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="parley-checkpoint-")


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one run's tables and streaming state."""
    return f"{checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df``, written once to a fresh shared folder and read back: what comes after it may
    use it several times, and a lost executor costs a read."""
    path = run_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
