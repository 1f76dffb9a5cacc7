"""Bounded samples of labelled documents, for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.shared import small


def held_out(doc_id: Column) -> Column:
    """A fifth of all documents, by id, that no model learns from; so are rows without one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of the ``most`` labelled documents with the least hashes, held-out
    ones left out; a document with several labels has the least, and the least of its texts.

    Only ids are ordered; the texts of those drawn are dealt over all cores.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min(label).cast("int").alias("label"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    there = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    drawn = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = texts.join(small(drawn, most), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").alias("label"))
    return found.repartition(documents.sparkSession.sparkContext.defaultParallelism)
