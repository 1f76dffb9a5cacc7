"""Periodic stretches of words: every run of a text, and the text with its runs cut down to
one period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of
at least ``LEAST`` words and ``TIMES`` periods, which no neighbouring word extends.

1. Words become numbers (exact, by dictionary code).  In a run of that length every five
   consecutive words stand at least twice; stretches where this holds, counted within the
   stretch again until nothing changes, are all that is looked at further.
2. Phase one of a suffix sorter by Baier groups the suffixes of a stretch: groups from the
   highest to the lowest hand each suffix before theirs, in a lower group, their own
   context.  When all groups are done, a suffix's context is the longest Lyndon word that
   starts there.  Done for the order of the numbers and for its reverse, this gives both
   Lyndon arrays, with no suffix array.
3. Every run has a root that is such a longest Lyndon word under one of the orders.  So each
   Lyndon word is extended in both directions as far as words its length apart are equal
   (longest common extensions, from the nearest unequal pair on either side), and what is
   long enough is a run; its period is smallest, since Lyndon words are no powers.

Texts are looked at on their own, where they lie: no row leaves its task.  A task holds a few
MB of text, or one text.

Defined cases: a null or empty text, or one without words, has no runs and collapses to an
empty text.  Words are bytes, compared as such.  Runs of different periods may overlap; a
word goes if any run holds it after its first period.  Rows without a ``doc_id`` or with a
repeated one are texts of their own (without an id nothing is planted).  Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from parley.llm.words import ascii_words, mixed, raw_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 6
TIMES = 4
_GRAM = 5  # consecutive words that stand twice in every run of LEAST words and TIMES periods
_PIECE = 1 << 20  # bytes of text worked on at once
_SCHEMA = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_lengths(s: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word that starts at each place of ``s``."""
    n = len(s)
    by = np.argsort(s, kind="stable")
    new = np.flatnonzero(np.diff(s[by], prepend=s[by[:1]] - 1))
    sizes = np.diff(np.append(new, n))
    start_of = np.empty(n, "i8")  # a group is named by where it starts
    start_of[by] = np.repeat(new, sizes)
    end, context = [0] * n, [1] * n
    for at, size in zip(new.tolist(), sizes.tolist(), strict=True):
        end[at] = at + size
    place = np.empty(n, "i8")
    place[by] = np.arange(n)
    order, place, start_of = by.tolist(), place.tolist(), start_of.tolist()
    below = list(range(n + 1))  # below[i + 1]: where to look for the nearest suffix up to i in a lower group
    found = [0] * n
    high = n
    while high:
        low = start_of[order[high - 1]]
        group, width = order[low:high], context[low]
        for i in group:
            below[i + 1] = i
            found[i] = width
        times: dict[int, int] = {}
        for i in group:
            while below[i] != i:
                below[i] = i = below[below[i]]
            if i:
                times[i - 1] = times.get(i - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            moved.setdefault((-k, start_of[j]), []).append(j)
        for (k, old), members in sorted(moved.items()):
            at = end[old]
            fresh = at - len(members)
            longer = context[old] - k * width
            end[old] = fresh
            end[fresh], context[fresh] = at, longer
            for j in members:
                at -= 1
                other, spot = order[at], place[j]
                order[spot], place[other] = other, spot
                order[at], place[j] = j, at
                start_of[j] = fresh
        high = low
    return np.array(found, "i8")


def stretch_runs(s: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs of ``s`` that are long enough, as rows of (start, length, period) in order."""
    found = []
    for order in (s, -s):
        lengths = lyndon_lengths(order)
        for period in np.unique(lengths[lengths * times <= len(s)]).tolist():
            at = np.flatnonzero(lengths == period)
            unequal = np.concatenate([[-1], np.flatnonzero(s[:-period] != s[period:]), [len(s) - period]])
            behind = np.searchsorted(unequal, at)
            start, stop = unequal[behind - 1] + 1, unequal[behind] + period
            some = stop - start >= max(least, times * period)
            found.append(np.column_stack([start, stop - start, np.full(len(at), period)])[some])
    runs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), "i8")
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _stretches(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs may be: stretches of one text in which all windows of five words stand twice."""
    n = len(ids) - _GRAM + 1
    if n <= 0:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    spread = mixed(ids.astype("u8") + np.uint64(1))
    gram = np.zeros(n, "u8")
    for k in range(_GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + spread[k:k + n]
    at = np.flatnonzero(text[:n] == text[_GRAM - 1:])
    inside = text[at]
    while len(at):
        key = mixed(gram[at] + mixed(inside.astype("u8")))
        _, group, times = np.unique(key, return_inverse=True, return_counts=True)
        some = times[group] > 1
        if some.all():
            break
        at, inside = at[some], inside[some]
        # A stretch ends where a window is gone, or with what held it before.
        inside = np.cumsum((np.diff(at, prepend=at[:1] - 1) != 1) | (np.diff(inside, prepend=inside[:1]) != 0))
    if not len(at):
        return at, at
    first = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(inside) != 0)))
    start, stop = at[first], at[np.append(first[1:], len(at)) - 1] + _GRAM
    return start[stop - start >= LEAST], stop[stop - start >= LEAST]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a text of ``n`` words is made to repeat, and by which period: a tenth of the
    documents, by the crc32 of their id."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def runs_of(column: pa.Array, doc_ids: list[int | None], plant: bool) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """Of each text: its number of words, its runs, and what is left of it, collapsed."""
    data, at = raw_texts(column)
    starts, stops, text = ascii_words(data, at)
    n_texts, n = len(column), len(starts)
    per_text = np.bincount(text, minlength=n_texts)
    first = np.cumsum(per_text) - per_text
    word = np.arange(n)
    if plant:
        for t, (doc, words) in enumerate(zip(doc_ids, per_text.tolist(), strict=True)):
            if loop := planted(doc, words):
                a, period = loop
                word[first[t] + a:first[t] + words] = first[t] + a + np.arange(words - a) % period
    # All words end to end, a space behind each.
    sizes = stops - starts
    offsets = np.append(0, np.cumsum(sizes + 1))
    spot = np.repeat(starts - offsets[:-1], sizes + 1) + np.arange(offsets[-1])
    packed = np.append(data, np.uint8(32))[np.minimum(spot, len(data))]
    packed[offsets[1:] - 1] = 32
    known = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype("i8")), pa.py_buffer(packed)])
    ids = pc.dictionary_encode(known).indices.to_numpy(zero_copy_only=False).astype("i8")[word]
    found: list[list[np.ndarray]] = [[] for _ in range(n_texts)]
    kept = np.ones(n, bool)
    for lo, hi in zip(*(x.tolist() for x in _stretches(ids, text)), strict=True):
        for start, length, period in (runs := stretch_runs(ids[lo:hi])).tolist():
            kept[lo + start + period:lo + start + length] = False
        if len(runs):
            t = text[lo]
            found[t].append(runs + np.array([lo - first[t], 0, 0]))
    stay = word[kept]
    width = sizes[stay] + 1
    ends = np.append(0, np.cumsum(width))
    rest = packed[np.repeat(offsets[stay] - ends[:-1], width) + np.arange(ends[-1])].tobytes()
    edge = ends[np.append(0, np.cumsum(np.bincount(text[kept], minlength=n_texts)))].tolist()
    none = np.zeros((0, 3), "i8")
    all_runs = [np.concatenate(f) if f else none for f in found]
    return per_text, all_runs, [rest[a:max(a, b - 1)] for a, b in zip(edge, edge[1:], strict=False)]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    at, row = raw_texts(batch.column(1))[1], 0
    while row < batch.num_rows:
        behind = max(row + 1, int(np.searchsorted(at, at[row] + _PIECE, "right")) - 1)
        yield batch.slice(row, behind - row)
        row = behind


def find_runs(documents: DataFrame, plant: bool = False) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): ``n_words``, ``runs`` (start, length, period;
    by start, then period) and ``collapsed``, the words that stay, joined by one space.

    With ``plant``, a tenth of the texts is made to repeat first (``planted``).
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch) if batch.num_rows else ():
                n, runs, rest = runs_of(piece.column(1), piece.column(0).to_pylist(), plant)
                flat = np.concatenate(runs)
                offsets = np.append(0, np.cumsum([len(r) for r in runs])).astype("i4")
                held = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN))
                yield pa.record_batch(
                    [piece.column(0), pa.array(n.astype("i8")), pa.ListArray.from_arrays(pa.array(offsets), held),
                     pa.array(rest, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(find, _SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run, and digests in place of runs and texts."""
    # The greatest (length, then least start and period).
    ranked = F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ranked)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    told = found.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
