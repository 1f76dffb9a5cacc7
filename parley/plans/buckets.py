"""Tables in hash buckets of a key: a folder for each bucket, rows sorted by key, with Parquet
Bloom filters.

Who looks a few keys up reads the folders of the buckets these keys fall into, and of those
the row groups that may hold them.  What passes the driver is bounded: bucket numbers, and
keys only if there are ``PUSHED`` of them at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64
PUSHED = 200


def bucket_of(key, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, mode: str = "errorifexists", buckets: int = BUCKETS) -> None:
    """Write ``df`` below ``path``; a bucket larger than the session's partition size is
    written by several tasks."""
    dealt = df.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
    (
        dealt.sortWithinPartitions("bucket", key).write.partitionBy("bucket").mode(mode)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", "200000")
        .parquet(path)
    )


def hit_buckets(rows: DataFrame, *keys: str, buckets: int = BUCKETS) -> list[list[int]]:
    """For each key column of ``rows``, the buckets its values fall into, by one pass."""
    found = rows.agg(*(F.collect_set(F.when(F.col(k).isNotNull(), bucket_of(k, buckets))).alias(k) for k in keys)).first()
    return [sorted(found[k]) for k in keys]


def read_hit(spark: SparkSession, schema: str, base: str, paths: list[str], hit: list[int]) -> DataFrame:
    """The rows of the buckets in ``hit``, of a table whose parts lie in ``paths`` below ``base``."""
    if not paths or not hit:
        return spark.createDataFrame([], schema)
    held = spark.read.schema(f"{schema}, bucket int").option("basePath", base).parquet(*paths)
    return held.where(F.col("bucket").isin(hit)).drop("bucket")


def few_keys(rows: DataFrame, key: str, most: int = PUSHED) -> list | None:
    """The distinct keys, if there are ``most`` of them at most: a scan can then leave out row
    groups by their Bloom filters."""
    keys = [r[0] for r in rows.select(key).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()]
    return keys if len(keys) <= most else None
