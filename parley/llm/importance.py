"""Importance resampling towards a target distribution, over hashed word windows.

A text's features are its runs of 1 to ``LONGEST`` consecutive words, repeats counted; a
feature falls into bucket crc32 modulo ``BUCKETS``.  All raw documents and all target texts
give a count per bucket, a bucket's gain is the scaled logarithm of how much likelier it is
in the target, and a document's weight is the sum of the gains of its features.  Weight plus
Gumbel noise, drawn from the document's id, is its score; the documents with the highest
scores are a sample without replacement in proportion to their importance.

CRCs are taken over length-bucketed matrices.  Of a slice of texts the distinct features
(exact: by dictionary codes of words, of pairs, of triples) are grouped by their number of
bytes into two-dimensional uint8 arrays; the CRCs of a whole matrix are updated column by
column, and the buckets scattered back to the features' places.  The few features longer
than ``MATRIX_BYTES`` are hashed one by one.

Each text is read once: its buckets are written (two bytes a feature), and both the counts
and the weights are read from there.  What passes the driver: a count for each bucket, and
a row for each task of the final sort.

Defined cases: a null or empty text, or one without words, has no features and weight 0.  A
row without a ``doc_id`` has no noise: its score and rank are null, and it does not count
among the documents to draw from.  Rows that repeat a ``doc_id`` are documents of their own
with the same noise; ties go to the smaller id, then to more features, then are broken by
place.  Without documents or target the counts are 0 and the gains follow from that.  Other
columns are ignored.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.shared import prefix_bases, slices, small, written
from parley.llm.words import lowered, raw_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = 3
BUCKETS = 10_000
PERCENT = 5
LEAST_WORDS = 20
SEED = "42"
MATRIX_BYTES = 256
_SLICE = 1024
_TABLE = "doc_id long, n_words long, buckets binary"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype="u4")
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc32s(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of data[start:start + size] for each span: spans of equal size form a matrix,
    whose CRCs are updated column by column."""
    table, found = _crc_table(), np.zeros(len(starts), "u4")
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for at, behind in zip(edges, edges[1:], strict=False):
        own = order[at:behind]
        size = int(sizes[own[0]])
        if size > MATRIX_BYTES:
            for i in own:
                found[i] = zlib.crc32(data[starts[i]:starts[i] + size])
            continue
        crc, place = np.full(len(own), 0xFFFFFFFF, "u4"), starts[own]
        matrix = data[place[None, :] + np.arange(size)[:, None]]
        for column in matrix:
            crc = table[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
        found[own] = ~crc
    return found


def _word_bytes() -> np.ndarray:
    """Which bytes belong to words, once A-Z are lower-cased: digits, letters, all beyond ASCII."""
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x80:] = True
    return inside


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, lower-cased, and the number of the text each lies in."""
    data, at = raw_texts(column)
    data = lowered(data)
    inside = _word_bytes()[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[at] = False  # a word ends with its text
    first = inside & ~before[:-1]
    starts = np.flatnonzero(first)
    # Words lie end to end once all other bytes are gone.
    offsets = np.append(np.cumsum(inside, dtype="i8")[starts] - 1, np.count_nonzero(inside))
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype("i8")), pa.py_buffer(data[inside])])
    return words, np.searchsorted(at, starts, "right") - 1


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's number among the distinct values, and those."""
    coded = pc.dictionary_encode(values)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype("i8"), coded.dictionary


def _ragged(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all spans end to end."""
    stops = np.cumsum(sizes)
    return data[np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)]


def feature_buckets(column: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its number of words, and its features' buckets, text by text (runs of
    one word first, then of two, and so on)."""
    words, text = words_of(column)
    n_texts, n = len(column), len(words)
    per_text = np.bincount(text, minlength=n_texts)
    if not n:
        return per_text, np.zeros(0, "u2")
    ids, known = _codes(words)
    _, offsets, data = known.buffers()
    offsets = np.frombuffer(offsets, "i8")[known.offset:known.offset + len(known) + 1]
    data = np.append(np.frombuffer(data, "u1")[:offsets[-1]], np.uint8(32))
    space = len(known)  # one more piece: a space
    starts, sizes = np.append(offsets[:-1], offsets[-1]), np.append(np.diff(offsets), 1)
    left = np.repeat(np.cumsum(per_text), per_text) - np.arange(n)  # words from here to the text's end
    first_of_text = np.cumsum([per_text] + [np.maximum(per_text - k, 0) for k in range(1, longest)], 0)
    base = np.cumsum(first_of_text[-1]) - first_of_text[-1]
    out = np.zeros(int(first_of_text[-1].sum()), "u2")
    place = np.arange(n) - (np.cumsum(per_text) - per_text)[text]
    code, pieces = ids, np.arange(len(known))[:, None]
    at = np.arange(n)  # where the runs start
    for k in range(longest):
        if k:
            longer = left[at] > k
            at = at[longer]
            key, known_runs = _codes(pa.array(code[longer] * len(known) + ids[at + k]))
            run = known_runs.to_numpy(zero_copy_only=False)
            pieces = np.column_stack([pieces[run // len(known)], np.full(len(run), space), run % len(known)])
            code = key
        flat = pieces.ravel()
        size = sizes[pieces].sum(1)
        crc = crc32s(_ragged(data, starts[flat], sizes[flat]), np.cumsum(size) - size, size)
        own = text[at]
        before = base[own] + (first_of_text[k - 1][own] if k else 0)
        out[before + place[at]] = (crc % np.uint32(buckets)).astype("u2")[code]
    return per_text, out


def bucket_table(documents: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Per row of (doc_id, text): ``n_words`` and ``buckets``, unsigned 16-bit each."""
    if buckets > 1 << 16:
        raise ValueError("buckets are 16 bits wide")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _SLICE):
            per_text, found = feature_buckets(batch.column(1), longest, buckets)
            each = sum(np.maximum(per_text - k, 0) for k in range(longest))
            offsets = np.concatenate([[0], np.cumsum(each * 2)]).astype("i4")
            held = pa.Array.from_buffers(pa.binary(), len(per_text), [None, pa.py_buffer(offsets), pa.py_buffer(found)])
            yield pa.record_batch([batch.column(0), pa.array(per_text.astype("i8")), held], ["doc_id", "n_words", "buckets"])

    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(narrow.mapInArrow(features, _TABLE), "importance-buckets")


def bucket_counts(held: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: every task sums its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in batches:
            for found in batch.column(0):
                total += np.bincount(np.frombuffer(found.as_buffer(), "u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype("i4")), pa.array(total[some])], ["bucket", "n"])

    sums = held.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, "i8")
    for bucket, n in sums.collect():  # a row for each bucket at most
        total[bucket] = n
    return total


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket."""
    n = len(raw)
    all_raw, all_target = float(raw.sum() + n), float(target.sum() + n)
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * all_raw / ((float(s) + 1) * all_target)))
        for s, t in zip(raw.tolist(), target.tolist(), strict=True)], "i8")


def weights(held: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)"""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), "u2") for x in batch.column(2)]
            n = pa.array([len(x) for x in found], pa.int64())
            weight = pa.array([int(gains[x].sum()) for x in found], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), n, weight], ["doc_id", "n_words", "n_features", "weight"])

    return held.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """1000 times a Gumbel variable that the id alone decides, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """``weighed`` with ``score`` and ``rank``: 1, 2, 3, ... for the ``percent`` of the
    documents of ``least_words`` words or more that score highest, null for all others.

    Rows are dealt over tasks by ranges of the score; the tasks' counts, summed up, tell
    where each task's ranks start.
    """
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    drawable = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    scored = scored.withColumn("outside", ~drawable).withColumn("spread", F.monotonically_increasing_id())
    order = ["outside", F.desc("score"), "doc_id", F.desc("n_features"), "spread"]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("place", F.monotonically_increasing_id()).drop("spread"), "importance-order")
    part = F.shiftrightunsigned("place", 33).cast("int")
    totals = placed.groupBy(part.alias("part")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("outside")).alias("drawable"))
    most = totals.agg(F.coalesce(F.sum("drawable"), F.lit(0))).first()[0] * percent // 100
    bases = small(prefix_bases(totals, "part", "n", "base"))
    at = F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    told = placed.withColumn("part", part).join(bases, "part").withColumn("at", at)
    rank = F.when(~F.col("outside") & (F.col("at") <= most), F.col("at"))
    return told.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def importance(documents: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST,
               buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): ``n_words``, ``n_features``, ``weight`` towards the
    texts of ``target``, ``score``, and ``rank`` where it is drawn."""
    held = bucket_table(documents, longest, buckets)
    wanted = bucket_table(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    gains = bucket_gains(bucket_counts(held, buckets), bucket_counts(wanted, buckets))
    return ranked(weights(held, gains), percent, least_words, seed)


def resampled(documents: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents that are drawn, with all their columns and their ``importance_rank``.

    Rows that share a ``doc_id`` come together, with the best of their ranks.
    """
    drawn = importance(documents, target, **how).where("rank IS NOT NULL").groupBy("doc_id").agg(
        F.min("rank").alias("importance_rank"))
    return documents.join(drawn, "doc_id").select(*documents.columns, "importance_rank")
