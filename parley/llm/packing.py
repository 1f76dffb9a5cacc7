"""Concatenate and cut: all documents' tokens end to end, cut into windows of fixed length.

Pass one tokenizes each document once, appends the end id and writes the ids with their
place among the tokens of their task.  The tasks' totals, summed up, tell where each task's
tokens start in the whole.  Pass two cuts every document at the multiples of the window
length it reaches across.  Only the last window is short of tokens; it is padded.

Order is the order of the input's tasks and rows.  A null text counts as empty: it is the
end id alone.  Rows with a null or repeated ``doc_id`` are packed like all others, each row
a document of its own.  Other columns are ignored.  An empty table has no pieces.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from parley.llm.shared import ARROW_ROWS, prefix_bases, slices, small, written
from parley.llm.tokens import encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 1024
_SCHEMA = "part int, at long, doc_id long, n long, ids binary"


def token_table(documents: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Per document: ``ids`` (unsigned 32-bit, with the end id), their number ``n``, the
    task ``part`` that made them, and ``at``, the task's tokens before them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in slices(batches, ARROW_ROWS):
            ids, n = one.encode_ended(batch.column(1), end_id)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.record_batch(
                [pa.array(np.full(len(ids), part, "i4")), pa.array(starts), batch.column(0), pa.array(n), ids],
                ["part", "at", "doc_id", "n", "ids"])

    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(narrow.mapInArrow(encode, _SCHEMA), "token-ids")


def pack(documents: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (its document's tokens before it), ``ids``,
    ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, and whether the piece
    ``opens`` and ``closes`` its document: a boundary record has one of them false."""
    ids = token_table(documents, vocabulary, end_id)
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    placed = ids.join(small(prefix_bases(totals, "part", "total", "base")), "part")
    first = F.col("base") + F.col("at")
    cut = placed.select(
        "doc_id", "n", "ids", first.alias("first"),
        F.explode(F.sequence(F.floor(first / window), F.floor((first + F.col("n") - 1) / window))).alias("sequence_id"))
    opens = F.col("sequence_id") * window
    start = F.greatest(opens - F.col("first"), F.lit(0))
    stop = F.least(opens + window - F.col("first"), F.col("n"))
    return cut.select(
        "doc_id", start.alias("start"),
        F.substring("ids", (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id",
        F.greatest(F.col("first") - opens, F.lit(0)).alias("offset"),
        (start == 0).alias("opens"), (stop == F.col("n")).alias("closes"))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The padded windows: ``sequence_id``, ``ids`` (``window`` of them), ``n_tokens``.

    A window has ``window`` pieces at most.
    """
    grouped = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    pad = np.full(window, pad_id, "<u4").tobytes()
    joined = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    n = F.octet_length("ids") / 4
    return grouped.select("sequence_id", joined.alias("ids")).select(
        "sequence_id", n.cast("long").alias("n_tokens"),
        F.substring(F.concat("ids", F.lit(pad)), F.lit(1), F.lit(4 * window)).alias("ids"))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces without their ids: ``length`` and ``ids_crc32`` stand for them."""
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
