"""What the operators of this package share: tables, written intermediates, Arrow helpers."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.session import run_folder

# Ship the task functions with the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A table of at most this many rows and, if they are not of fixed width, bytes may be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
ARROW_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df``, written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs a read, not the work that led here.  Rows pass
    to Python in batches of ``ARROW_ROWS`` meanwhile: Spark's batches are bounded by rows
    alone, and rows are whole texts here.
    """
    spark = df.sparkSession
    path = run_folder(spark, purpose)
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(usual), ARROW_ROWS)))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, usual)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS, size: int | None = None) -> DataFrame:
    """``df`` (cheap to count), marked for broadcast if it has ``most`` rows at most, and
    ``size`` bytes (``BROADCAST_BYTES``) where it holds strings, binaries or arrays (as JSON,
    which is wider).

    Beyond that it is left to a shuffled join.
    """
    few = df.limit(most + 1)
    if all(re.match(r"(big|small|tiny)?int$|double$|float$|boolean$|date$|timestamp", kind) for _, kind in df.dtypes):
        return F.broadcast(df) if few.count() <= most else df
    n, held = few.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    bound = BROADCAST_BYTES if size is None else size
    return F.broadcast(df) if n <= most and (held or 0) <= bound else df


# Bits of a sieve of keys; its table has a row for each 64 of them at most.
SIEVE_BITS = 1 << 26


def holding(facts: DataFrame, keys: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``facts`` whose ``key`` is one of ``keys``, without shuffling the others.

    Few keys are broadcast.  Of more, a sieve is: the bits that their hashes set, a table of
    bounded size whatever the number of keys.  Only rows that pass it are shuffled.
    """
    keys = keys.select(key).distinct()
    if keys.limit(most + 1).count() <= most:
        return facts.join(F.broadcast(keys), key, "left_semi").select(*facts.columns)
    h = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    word, bit = F.shiftright(h, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    sieve = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    passed = facts.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(sieve), "_word").where(
        F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    return passed.select(*facts.columns).join(keys, key, "left_semi").select(*facts.columns)


def prefix_bases(totals: DataFrame, part: str, total: str, base: str) -> DataFrame:
    """Per partition number, the sum of ``total`` over all lower ones.

    ``totals`` has a row per task of an earlier job: as many as the driver scheduled.
    """
    at, rows = 0, []
    for k, n in sorted((r[0], r[1]) for r in totals.select(part, total).collect()):
        rows.append((k, at))
        at += n
    return totals.sparkSession.createDataFrame(rows, f"{part} int, {base} long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows`` rows, so that texts of one piece stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
