"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A batch of changes says which documents are new, gone, or counted anew.  It is committed as
signed sums: a new document adds its tokens, a gone one takes away what it last counted,
a revised one takes away the old count and adds the new one, under another source, language
or tokenizer version where those changed.  Totals are the sum of all committed deltas, so
no batch reads the corpus again.

Under the store's folder:

    changes/batch=N  what came with batch N, stored once
    log/batch=N      the signed rows of batch N, by document, in hash buckets of the document
    deltas/batch=N   their sums by source, language and version
    commits/batch=N  one row, written last: batch N counts from then on

A batch is written into folders of its own, so a run that broke off is simply repeated, and
a batch that is committed already is left alone.  Batches are committed one after another,
with growing numbers.  A batch reads the log of the buckets that its documents fall into, no
others.  ``compact`` folds the log and deltas up to a batch into one.

Defined cases: within a batch the row with the highest ``seq`` of a document counts (ties:
the one with most tokens, then by source, language and version); rows without a
``doc_id`` cannot be found again and do not count (``refused`` returns them); deleting an unknown
document changes nothing; a null source, language or version is a group of its own; a null
or empty text has no tokens; columns beyond those named are ignored; an empty batch commits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm.shared import ARROW_ROWS, slices, small
from parley.llm.tokens import encoder
from parley.plans.buckets import bucket_of, hit_buckets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["source", "lang", "version"]
_LOG = "doc_id long, source string, lang string, version string, n_tokens long, sign int"
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long"
_COMMIT = "done boolean"


def count_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``documents`` (doc_id, text, source, lang) with ``n_tokens`` in place of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(vocabulary)
        for batch in slices(batches, ARROW_ROWS):
            _, n = one.encode_column(batch.column(3))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n)],
                ["doc_id", "source", "lang", "n_tokens"])

    narrow = documents.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"),
        F.col("text").cast("string"))
    return narrow.mapInArrow(count, "doc_id long, source string, lang string, n_tokens long")


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        """All rows of one kind with their batch; empty before the first batch."""
        try:
            return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], f"{schema}, batch long")

    def committed(self) -> list[int]:
        """The numbers of the committed batches: a row for each."""
        return sorted(r.batch for r in self._read("commits", _COMMIT).select("batch").distinct().collect())

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Commit ``changes``: op (insert, revise: the document's count from now on;
        delete), seq, doc_id, source, lang, version, n_tokens.

        False, and nothing done, if the batch is committed already.
        """
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        known = changes.where(F.col("doc_id").isNotNull())
        last = known.groupBy("doc_id").agg(F.max(F.struct(
            "seq", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), *KEYS, "op")).alias("c"))
        now = last.select(F.col("doc_id").cast("long"), *(F.col(f"c.{k}").cast("string").alias(k) for k in KEYS),
                          F.col("c.n_tokens").cast("long").alias("n_tokens"), F.col("c.op").alias("op"))
        # What counts the tokens runs once.
        self._write(now, "changes", batch)
        now = self.spark.read.schema(now.schema).parquet(f"{self.folder}/changes/batch={batch}")
        signed = now.where("op <> 'delete'").select("doc_id", *KEYS, "n_tokens", F.lit(1).alias("sign"))
        if done:
            (hit,) = hit_buckets(now, "doc_id")
            old = self.current(hit).join(now.select("doc_id"), "doc_id", "left_semi")
            signed = old.select("doc_id", *KEYS, "n_tokens", F.lit(-1).alias("sign")).unionByName(signed)
        self._write(signed.withColumn("bucket", bucket_of("doc_id")), "log", batch, "bucket")
        log = self.spark.read.schema(_LOG).parquet(f"{self.folder}/log/batch={batch}")
        self._write(_sums(log), "deltas", batch)
        self._write(self.spark.range(1).select(F.lit(True).alias("done")), "commits", batch)
        return True

    def _write(self, df: DataFrame, name: str, batch: int, *by: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.folder}/{name}/batch={batch}")

    def current(self, hit: list[int] | None = None) -> DataFrame:
        """What each live document counts now (those in the buckets ``hit`` alone): a document's
        signs add up to one for its last count and to none for all earlier ones."""
        log = self._of_committed("log", f"{_LOG}, bucket int")
        if hit is not None:
            log = log.where(F.col("bucket").isin(hit))
        return log.groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").alias("live")).where("live > 0").drop("live")

    def _of_committed(self, name: str, schema: str) -> DataFrame:
        commits = self._read("commits", _COMMIT).select("batch").distinct()
        return self._read(name, schema).join(small(commits), "batch", "left_semi")

    def totals(self) -> DataFrame:
        """``n_docs`` and ``n_tokens`` per source, language and version with documents."""
        sums = self._of_committed("deltas", _DELTA).groupBy(*KEYS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, into: Rollup) -> None:
        """Write the state as the first batch of another store."""
        batch = self.committed()[-1]
        into.commit(batch, self.current().select(
            F.lit("insert").alias("op"), F.lit(0).cast("long").alias("seq"), "doc_id", *KEYS, "n_tokens"))


def _sums(log: DataFrame) -> DataFrame:
    return log.groupBy(*KEYS).agg(
        F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))


def refused(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("doc_id").isNull())
