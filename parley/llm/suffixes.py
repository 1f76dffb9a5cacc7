"""Removal of repeated strings, by a distributed sort of sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the
same text or another one.  To find these strings not every suffix has to be sorted:

1. Each window of ``LENGTH`` bytes names one of its grams (``GRAM`` bytes; the least by hash,
   then the leftmost) its anchor.  Equal windows name it at the same place, so only suffixes
   that start at anchors are compared.  Consecutive windows share their anchor; a record
   is an anchor with the stretch of text that its windows cover: what follows the anchor is
   the suffix, what stands before it lets windows begin there.
2. Records that are equal over their whole stretch are one record that occurs several times;
   their windows repeat.  Copies are folded within a task and, after sampled splitters have
   range-partitioned the records by gram, within a bucket; grams that reach over a bucket's
   ends are folded across buckets.
3. Records that differ although their grams are equal are compared as suffixes.  Their
   stretches are fetched, range-partitioned by their first ``LEAD`` bytes with sampled splitters
   (and dealt by place beyond that, so a frequent lead spreads over many buckets), and each
   bucket sorts its suffixes by multikey quicksort, eight bytes a key.  The lengths that
   neighbours share tell for each window which suffixes agree from the anchor to the
   window's end; the same sort over the bytes before the anchor, read backwards, tells which
   agree back to the window's start.  A window repeats where both do.
4. Across boundaries: a window can stand in another bucket only if its suffix agrees up to
   the window's end (or in its whole lead) with the first or last suffix of its own.  Of such
   windows a bucket sends each distinct one on once, by 128 bits, with its place if the
   bucket held it only once.  Windows that two buckets sent repeat.
5. A text's windows that repeat are joined with it by a 128-bit digest of its id and text,
   merged, and cut out.

Rows that leave their task: some 50 bytes for each anchor (an anchor for every 100 to 200
bytes of text), the stretches of step 3, and each text twice.

Defined cases: a null text is empty.  Rows that repeat a ``doc_id`` or have none are texts
of their own.  Equal texts of ``LENGTH`` bytes or more are removed whole, all of them.  Removal is
by bytes, so a character of several bytes may be cut.  Empty tables give empty results.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from parley.llm.shared import small, written
from parley.llm.words import Hasher, mixed, raw_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 400
GRAM = 32
LEAD = 128
_PIECE = 1 << 19  # bytes of text worked on at once
_FOLD = 100_000  # records a task folds at once
_KEY = ["gram", "d1", "d2", "off"]
_RECORD = "gram long, d1 long, d2 long, off int, row binary, start int, stop int, n int, own boolean"
_SPAN = "row binary, start int, stop int"


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys: from the ends of blocks of that width."""
    n = len(key)
    blocks = np.full(-(-n // width) * width, ~np.uint64(0), "u8")
    blocks[:n] = key
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], before[width - 1:n])


_PERMUTED = np.argsort(mixed(np.arange(256, dtype="u8"))).astype("u1")


def _twin(data: np.ndarray) -> np.ndarray:
    """The bytes under a fixed permutation, for a second hash."""
    return _PERMUTED[data]


def anchors(data: np.ndarray, at: np.ndarray, hasher: Hasher, length: int, gram: int) -> dict[str, np.ndarray]:
    """Records of the texts data[at[i]:at[i + 1]]: ``text``, ``start`` and ``stop`` of the stretch
    (in ``data``), ``off`` from there to the anchor, hash of the ``gram``, digest ``d1``, ``d2``."""
    n = len(data) - length + 1
    if n <= 0:
        return {k: np.zeros(0, "i8") for k in ("text", "start", "stop", "off", "gram", "d1", "d2")}
    place = np.arange(len(data) - gram + 1)
    hashes = hasher.spans(data, place, place + gram)
    low = np.uint64(_PIECE - 1)
    least = _sliding_least((hashes & ~low) | place.astype("u8"), length - gram + 1)
    text = np.searchsorted(at, np.arange(n), "right") - 1
    whole = np.flatnonzero(np.arange(n) + length <= at[text + 1])
    named = (least[whole] & low).astype("i8")
    first = np.flatnonzero(np.diff(named, prepend=-1))
    last = np.append(first[1:], len(whole)) - 1
    start, stop = whole[first], whole[last] + length if len(whole) else whole[first]
    spot = named[first]
    return {
        "text": text[start], "start": start, "stop": stop, "off": spot - start, "gram": hashes[spot].view("i8"),
        "d1": hasher.spans(data, start, stop).view("i8"), "d2": hasher.spans(_twin(data), start, stop).view("i8")}


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts in pieces of some size: bytes, where each part starts, its text's number and
    its place in that text.  Parts of one text overlap by a window less one byte."""
    data, at = raw_texts(column)
    n, row = len(column), 0
    while row < n:
        if at[row + 1] - at[row] > _PIECE:
            for lo in range(0, int(at[row + 1] - at[row]) - length + 1, _PIECE - length + 1):
                part = data[at[row] + lo:min(at[row] + lo + _PIECE, at[row + 1])]
                yield part, np.array([0, len(part)]), np.array([row]), np.array([lo])
            row += 1
            continue
        behind = max(row + 1, int(np.searchsorted(at, at[row] + _PIECE, "right")) - 1)
        yield data[at[row]:at[behind]], at[row:behind + 1] - at[row], np.arange(row, behind), np.zeros(behind - row, "i8")
        row = behind


def _group(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct row of the columns, counted up in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    group = np.empty(len(order), "i8")
    group[order] = np.cumsum(new)
    return group


def _fold(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records: each one's number among the distinct ones, the first of each, and how
    often each occurs."""
    group = _group(*(t[k] for k in _KEY))
    _, first = np.unique(group, return_index=True)
    return group, first, np.bincount(group, weights=t["n"], minlength=len(first)).astype("i8")


def _spans_batch(row: pa.Array, start: np.ndarray, stop: np.ndarray) -> dict[str, pa.Array]:
    return {"row": row, "start": pa.array(start.astype("i4")), "stop": pa.array(stop.astype("i4"))}


def _record_batch(t: dict, at: np.ndarray, n: np.ndarray, own: np.ndarray, **more) -> pa.RecordBatch:
    columns = {k: pa.array(t[k][at]) for k in _KEY[:3]} | {"off": pa.array(t["off"][at].astype("i4"))}
    columns |= _spans_batch(t["row"].take(pa.array(at)), t["start"][at], t["stop"][at])
    columns |= {"n": pa.array(np.minimum(n, 2).astype("i4")), "own": pa.array(own)} | more
    return pa.record_batch(list(columns.values()), list(columns))


def records(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The records of ``texts`` (row, text), folded within each task.

    ``n`` is 2 for a record that occurs several times.  ``own``: its place stands for itself
    alone.  Of the others, the places that repeat are rows without a gram.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, rows = Hasher(), [], 0

        def folded() -> Iterator[pa.RecordBatch]:
            t = {k: np.concatenate([h[k] for h in held]) for k in (*_KEY, "start", "stop", "n")}
            t["row"] = pa.concat_arrays([h["row"] for h in held])
            group, first, n = _fold(t)
            yield _record_batch(t, first, n, n[group[first]] == 1)
            again = np.flatnonzero(n[group] > 1)
            spans = _spans_batch(t["row"].take(pa.array(again)), t["start"][again], t["stop"][again])
            none = pa.nulls(len(again), pa.int64())
            columns = {"gram": none, "d1": none, "d2": none, "off": pa.nulls(len(again), pa.int32())} | spans
            columns |= {"n": pa.nulls(len(again), pa.int32()), "own": pa.nulls(len(again), pa.bool_())}
            yield pa.record_batch(list(columns.values()), list(columns))

        for batch in batches:
            for data, at, text, lo in _pieces(batch.column(1), length):
                t = anchors(data, at, hasher, length, gram)
                part = t.pop("text")
                shift = lo[part] - at[part]
                t["start"], t["stop"] = t["start"] + shift, t["stop"] + shift
                t["row"], t["n"] = batch.column(0).take(pa.array(text[part])), np.ones(len(part), "i8")
                held.append(t)
                rows += len(part)
                if rows > _FOLD:
                    yield from folded()
                    held, rows = [], 0
        if rows:
            yield from folded()

    return texts.select("row", "text").mapInArrow(find, _RECORD)


def _numbers(batch: pa.RecordBatch | pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    return {k: batch.column(k).to_numpy().astype("i8") for k in names}


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _buckets_folded(found: DataFrame) -> DataFrame:
    """Records range-partitioned by gram and folded in their buckets: ``kind`` "span" (a place
    that repeats), "suffix" (its gram has other records) or "end" (of a gram at a bucket's end)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        t = _numbers(table, [*_KEY, "start", "stop", "n"])
        row = table.column("row").combine_chunks()
        t["row"], own = row, table.column("own").to_numpy()
        group, first, n = _fold(t)
        of_gram, per_gram = np.unique(t["gram"][first], return_inverse=True, return_counts=True)[1:]
        end = (t["gram"][first] == t["gram"].min()) | (t["gram"][first] == t["gram"].max())
        again = np.flatnonzero((n[group] > 1) & own)
        alone = own[first] & (n == 1)
        for kind, at in (("suffix", np.flatnonzero((per_gram[of_gram] > 1) & ~end)), ("end", np.flatnonzero(end))):
            yield _record_batch(t, first[at], n[at], alone[at], kind=pa.array([kind] * len(at), pa.string()))
        yield _record_batch(t, again, n[group[again]], own[again], kind=pa.array(["span"] * len(again), pa.string()))

    dealt = found.where("gram IS NOT NULL").repartitionByRange("gram", "d1", F.xxhash64("row", "start"))
    return written(dealt.mapInArrow(fold, f"{_RECORD}, kind string"), "suffix-folded")


def _ends_folded(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of the grams at buckets' ends, folded across buckets: places that repeat, and
    suffixes.  A bucket sends each record once."""
    folded = written(ends.groupBy(*_KEY).agg(
        F.sum("n").alias("n"), F.min(F.struct("row", "start", "stop")).alias("one"),
        F.collect_list(F.when(F.col("own"), F.struct("row", "start", "stop"))).alias("own")), "suffix-ends")
    spans = folded.where("n > 1").select(F.explode("own").alias("s")).select("s.*")
    crowded = folded.groupBy("gram").agg(F.count("*").alias("others")).where("others > 1").select("gram")
    several = folded.join(small(crowded), "gram").select(
        *_KEY, "one.*", F.least("n", F.lit(2)).cast("int").alias("n"), (F.col("n") == 1).alias("own"))
    return spans, several


def _stretches(texts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The suffixes with the ``bytes`` of their stretches."""
    wanted = suffixes.groupBy("row").agg(F.collect_list(F.struct("start", "stop", "off", "own")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                held = [data[w["start"]:w["stop"]] for w in asked]
                yield pa.record_batch(
                    [pa.array([row] * len(held), pa.binary()), pa.array([w["start"] for w in asked], pa.int32()),
                     pa.array([w["off"] for w in asked], pa.int32()), pa.array([w["own"] for w in asked], pa.bool_()),
                     pa.array(held, pa.binary())],
                    ["row", "start", "off", "own", "bytes"])

    told = texts.join(wanted, "row").select("row", "text", "wanted")
    return told.mapInArrow(cut, "row binary, start int, off int, own boolean, bytes binary")


def quicksorted(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings, filled up with zeros to ``width`` bytes: their order, and
    how many bytes each shares with the one before it in that order.

    Eight bytes are one key: all groups that agree so far are split by their next key, and
    strings that stand alone are done.
    """
    wide = -(-width // 8) * 8
    data = np.zeros((len(strings), wide), "u1")
    for i, s in enumerate(strings):
        data[i, :len(s)] = np.frombuffer(s, "u1")
    order, new = np.arange(len(strings)), np.zeros(len(strings), bool)
    new[:1] = True  # starts a group
    for key in data.view(">u8").T:
        behind = np.append(new[1:], True)
        open_ = np.flatnonzero(~(new & behind))
        if not len(open_):
            break
        group, keys = np.cumsum(new)[open_], key[order[open_]].astype("u8")
        by = np.lexsort((keys, group))
        order[open_] = order[open_][by]
        keys = keys[by]
        new[open_[1:]] |= keys[1:] != keys[:-1]
    shared = np.zeros(len(strings), "i8")
    for at in range(1, len(strings), 4096):
        rows = np.arange(at, min(at + 4096, len(strings)))
        differ = data[order[rows]] != data[order[rows - 1]]
        shared[rows] = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.minimum(shared, width)


def _nearest(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """What each string shares with any other, at most: with a neighbour."""
    most = np.zeros(len(order), "i8")
    most[order] = np.maximum(shared, np.append(shared[1:], 0))
    return most


def _reach(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """What each string shares with the first or the last of all, at most."""
    most = np.full(len(order), np.iinfo("i8").max)
    forth, back = most.copy(), most.copy()
    forth[1:] = np.minimum.accumulate(shared[1:])
    back[:-1] = np.minimum.accumulate(shared[:0:-1])[::-1]
    most[order] = np.maximum(forth, back)
    return most


def repeated_windows(held: list[bytes], off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches with their anchors: (number, bytes before the anchor) of each window that
    stands in two of them; and how many bytes from its anchor each shares with the first or
    last of them in order."""
    right, shared_right = quicksorted([x[o:] for x, o in zip(held, off.tolist(), strict=True)], length)
    left, shared_left = quicksorted([x[:o][::-1] for x, o in zip(held, off.tolist(), strict=True)], max(int(off.max()), 1))
    size = np.array([len(x) for x in held]) - off
    least = np.maximum(length - size, length - _nearest(right, shared_right))
    most = np.minimum(off, _nearest(left, shared_left))
    live = np.flatnonzero(least <= most)
    who, before = [], []
    for b in range(int(least[live].min()), int(most[live].max()) + 1) if len(live) else ():
        own = live[(least[live] <= b) & (b <= most[live])]
        if len(own) < 2:
            continue
        agree = np.empty((2, len(held)), "i8")
        agree[0, right], agree[1, left] = np.cumsum(shared_right < length - b), np.cumsum(shared_left < b)
        key = agree[0, own] * (len(held) + 1) + agree[1, own]
        _, group, n = np.unique(key, return_inverse=True, return_counts=True)
        own = own[n[group] > 1]
        who.append(own)
        before.append(np.full(len(own), b))
    none = np.zeros(0, "i8")
    return np.concatenate([none, *who]), np.concatenate([none, *before]), _reach(right, shared_right)


_PLACE = np.dtype([("row", "V16"), ("start", "<i4")])


def _windows(held: list[bytes], n: np.ndarray, own: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The distinct ones of the first ``n`` windows of each stretch: hash, stretch, place in it,
    and whether it stands nowhere else here and its stretch neither."""
    hasher, sizes = Hasher(), np.array([len(x) for x in held])
    data = np.frombuffer(b"".join(held), "u1")
    who = np.repeat(np.arange(len(held)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = at + (np.cumsum(sizes) - sizes)[who]
    f = np.column_stack([hasher.spans(data, start, start + length), hasher.spans(_twin(data), start, start + length)])
    group = _group(f[:, 0], f[:, 1])
    _, first = np.unique(group, return_index=True)
    alone = np.bincount(group)[group[first]] == 1
    return f[first], who[first], at[first], alone & own[who[first]]


def _sorted_buckets(stretches: DataFrame, length: int) -> DataFrame:
    """Suffixes sorted and compared in buckets.  Rows without a ``slice`` are places that repeat.
    The others hold distinct windows that may stand in other buckets: their hashes ``f``, and
    of the first ones, of which the bucket does not know yet, the ``places`` (row, start)."""
    slices = int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(f: np.ndarray, open_: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        piece = (f[:, 0] % np.uint64(slices)).astype("i8")
        order = np.lexsort((~open_, piece))
        f, open_, places, piece = f[order], open_[order], places[order], piece[order]
        edge = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
        held = [(int(piece[a]), f[a:b].tobytes(), places[a:b][open_[a:b]].tobytes()) for a, b in zip(edge, edge[1:], strict=False)]
        columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]
        none = [pa.nulls(len(held), t) for t in (pa.binary(), pa.int32(), pa.int32())]
        return pa.record_batch([*columns, *none], ["slice", "f", "places", "row", "start", "stop"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        held, off = table.column("bytes").to_pylist(), table.column("off").to_numpy().astype("i8")
        row, start = table.column("row").combine_chunks(), table.column("start").to_numpy().astype("i8")
        own = table.column("own").to_numpy()
        who, before, reach = repeated_windows(held, off, length)
        unknown = own[who]
        who, before = who[unknown], before[unknown]
        by = np.lexsort((before, who))
        who, before = who[by], before[by]
        edge = np.ones(len(who) + 1, bool)
        edge[1:-1] = (np.diff(who) != 0) | (np.diff(before) != 1)
        first, last = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
        anchor = start + off
        spans = _spans_batch(row.take(pa.array(who[first])), anchor[who[first]] - before[last], anchor[who[first]] - before[first] + length)
        none = [pa.nulls(len(first), t) for t in (pa.int32(), pa.binary(), pa.binary())]
        yield pa.record_batch([*none, *spans.values()], ["slice", "f", "places", *spans])
        every = np.array([len(x) for x in held]) - length + 1
        n = np.where(reach >= LEAD, every, np.clip(off - (length - reach) + 1, 0, every))
        at = np.flatnonzero(n > 0)
        f, number, place, open_ = _windows([held[i] for i in at], n[at], own[at], length)
        rows = np.frombuffer(b"".join(row.take(pa.array(at)).to_pylist()), "V16")
        places = np.zeros(len(f), _PLACE)
        places["row"], places["start"] = rows[number], start[at[number]] + place
        yield packed(f, open_, places)

    lead = F.substr("bytes", F.col("off") + 1, F.lit(LEAD))
    dealt = stretches.repartitionByRange(lead, F.xxhash64("row", "start"))
    return written(dealt.mapInArrow(compare, f"slice int, f binary, places binary, {_SPAN}"), "suffix-compared")


def _across(sent: DataFrame, length: int) -> DataFrame:
    """Places of windows that more than one bucket sent."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        f = [np.frombuffer(x, "u8").reshape(-1, 2) for x in table.column("f").to_pylist()]
        places = [np.frombuffer(x, _PLACE) for x in table.column("places").to_pylist()]
        first = np.cumsum([0, *map(len, f)])[:-1]
        asked = np.concatenate([a + np.arange(len(p)) for a, p in zip(first, places, strict=True)])
        every = np.concatenate(f)
        group = _group(every[:, 0], every[:, 1])
        several = np.bincount(group)[group[asked.astype("i8")]] > 1
        found = np.concatenate(places)[several]
        rows = pa.Array.from_buffers(pa.binary(16), len(found), [None, pa.py_buffer(np.ascontiguousarray(found["row"]))])
        start = found["start"].astype("i8")
        yield pa.record_batch(list(_spans_batch(rows.cast(pa.binary()), start, start + length).values()), ["row", "start", "stop"])

    return sent.repartition("slice").mapInArrow(match, _SPAN)


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Spans of ``texts`` (row, text) that together cover just the bytes of repeated windows:
    (row, start, stop), in bytes."""
    gram = min(gram, length)
    found = written(records(texts, length, gram), "suffix-records")
    folded = _buckets_folded(found)
    of = ["row", "start", "stop"]
    more_spans, more = _ends_folded(folded.where("kind = 'end'").drop("kind"))
    suffixes = folded.where("kind = 'suffix'").select(*_KEY, *of, "n", "own").unionByName(more)
    compared = _sorted_buckets(_stretches(texts, suffixes), length)
    return (
        found.where("gram IS NULL").select(*of).unionByName(folded.where("kind = 'span'").select(*of))
        .unionByName(more_spans).unionByName(compared.where("slice IS NULL").select(*of))
        .unionByName(_across(compared.where("slice IS NOT NULL").select("slice", "f", "places"), length))
    )


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of the spans' union."""
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > far[:-1]
    first = np.flatnonzero(new)
    return starts[first], far[np.append(first[1:], len(starts)) - 1]


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): ``doc_id``, ``kept`` (the bytes that stay, end to end),
    ``n_bytes``, and ``removed``, the maximal runs (start, stop) that go."""
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))))
    spans = written(repeated_spans(texts, length), "suffix-spans").groupBy("row").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.encode()
                if not spans.is_valid:
                    kept.append(data)
                    gone.append([])
                    continue
                start, stop = merged(*(spans.values.field(k).to_numpy().astype("i8") for k in range(2)))
                ends = np.append(start, len(data)).tolist()
                kept.append(b"".join(data[a:b] for a, b in zip([0, *stop.tolist()], ends, strict=True)))
                gone.append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
            yield pa.record_batch(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array([len(t) for t in kept], pa.int64()),
                 pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                ["doc_id", "kept", "n_kept", "removed"])

    told = texts.join(spans, "row", "left").select("doc_id", "text", "spans")
    done = told.mapInArrow(cut, "doc_id long, kept binary, n_kept long, removed array<struct<start int, stop int>>")
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return done.withColumn("n_bytes", F.col("n_kept") + n_removed).select("doc_id", "n_bytes", "kept", "removed")


def digests(done: DataFrame) -> DataFrame:
    """Counts and a digest in place of bytes and spans."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return done.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
