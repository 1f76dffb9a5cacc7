"""Token ids in directly addressable codes: any id can be read without decoding others.

An id is cut into chunks of 8 bits, lowest first.  Level 0 holds the first chunk of every
id and a bitmap that tells which ids go on; level 1 holds the second chunk of those, with a
bitmap of its own, and so on.  Where an id goes on, its place in the next level is the
number of bits set before it: a directory holds that number for every block of 512 bits,
and the rest is counted in the block.

A file (``.dac``) holds a run of whole documents:

    magic "DAC1" | tokens, documents, levels, part, place in part: unsigned 64 bits each
    document ids, 64 bits each | their null flags, 8 bits each | first token of each, 64 bits
    per level: its length, 64 bits | its chunks | bitmap | directory, 64 bits a block

Numbers are little-endian.  Files follow ``doc_id``: a range of ids per task, split where a
file would hold more than ``FILE_TOKENS`` (a document is never split).  They are written
under a name of the attempt and renamed, so a repeated task leaves the same files.

A null text counts as empty and is the end id alone; null ids come first; rows that repeat
an id follow each other by their text's hash; other columns are ignored; an empty table has
no files.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from parley.llm.shared import ARROW_ROWS, prefix_bases, slices
from parley.llm.tokens import encoder
from parley.plans.sizing import partitions_for

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE_TOKENS = 4_000_000
BLOCK = 512  # bits of a bitmap per entry of its directory
_HEAD = "<4s5Q"
_MADE = "part int, k int, n_docs long, n_tokens long"


# ------------------------------------------------------------------ the code itself

def encode_levels(ids: np.ndarray) -> bytes:
    out, rest = [], ids.astype("<u8")
    levels = 0
    while levels == 0 or len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        per_block = np.unpackbits(bits).reshape(-1, BLOCK).sum(1, dtype="<u8")
        ranks = np.cumsum(per_block, dtype="<u8") - per_block
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype("u1").tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> np.uint64(8)
        levels += 1
    return b"".join(out)


class TokenFile:
    """Random access to a file through ``read(at, n)``."""

    def __init__(self, read):
        self.read = read
        magic, self.n_tokens, self.n_docs, self.n_levels, self.part, self.k = struct.unpack(_HEAD, read(0, struct.calcsize(_HEAD)))
        if magic != b"DAC1":
            raise ValueError("not a token file")
        self.places, at = [], struct.calcsize(_HEAD) + 17 * self.n_docs
        for _ in range(self.n_levels):
            (n,) = struct.unpack("<Q", read(at, 8))
            blocks = -(-n // BLOCK)
            ranks = at + 8 + n + blocks * (BLOCK // 8)
            self.places.append((n, at + 8, at + 8 + n, ranks))
            at = ranks + 8 * blocks

    def __len__(self) -> int:
        return self.n_tokens

    def __getitem__(self, i: int) -> int:
        """Id number ``i``: a chunk, a bit and at most one block's count per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (_, chunks, bits, ranks) in enumerate(self.places):
            value |= self.read(chunks + i, 1)[0] << (8 * level)
            block, bit = divmod(i, BLOCK)
            words = int.from_bytes(self.read(bits + block * (BLOCK // 8), BLOCK // 8), "little")
            if not words >> bit & 1:
                return value
            (before,) = struct.unpack("<Q", self.read(ranks + 8 * block, 8))
            i = before + (words & ((1 << bit) - 1)).bit_count()
        return value

    def all_ids(self) -> np.ndarray:
        values, at = np.zeros(self.n_tokens, "<u4"), np.arange(self.n_tokens)
        for level, (n, chunks, bits, _) in enumerate(self.places):
            values[at] |= np.frombuffer(self.read(chunks, n), "u1").astype("<u4") << np.uint32(8 * level)
            more = np.unpackbits(np.frombuffer(self.read(bits, -(-n // 8)), "u1"), bitorder="little")[:n]
            at = at[more.astype(bool)]
        return values

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, null flags and first tokens."""
        n, at = self.n_docs, struct.calcsize(_HEAD)
        return (np.frombuffer(self.read(at, 8 * n), "<i8"), np.frombuffer(self.read(at + 8 * n, n), "u1"),
                np.frombuffer(self.read(at + 9 * n, 8 * n), "<u8").astype("i8"))


def file_image(doc_ids: list[int | None], ids: list[bytes], part: int, k: int) -> bytes:
    lengths = np.array([len(x) // 4 for x in ids], "<u8")
    every = np.frombuffer(b"".join(ids), "<u4")
    levels = encode_levels(every)
    n_levels = max(1, -(-int(every.max(initial=0)).bit_length() // 8))
    return b"".join([
        struct.pack(_HEAD, b"DAC1", len(every), len(ids), n_levels, part, k),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], "u1").tobytes(),
        (np.cumsum(lengths, dtype="<u8") - lengths).tobytes(), levels])


# ------------------------------------------------------------------ files on the cluster

def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_codes(documents: DataFrame, folder: str, vocabulary: str, end_id: int,
                file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write all documents' ids under ``folder`` (a URI that every executor reaches).

    Returns the manifest, a row per file: ``part``, ``k``, ``n_docs``, ``n_tokens`` and
    ``base``, the tokens of all files before it; it is kept as Parquet beside the files.
    """
    files = f"{folder}/files"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, task = encoder(vocabulary), TaskContext.get()
        part, made, doc_ids, ids, held = task.partitionId(), [], [], [], 0
        store, root = _store(files)
        store.create_dir(root, recursive=True)

        def flush():
            name = f"{root}/{part:06d}-{len(made):06d}.dac"
            attempt = f"{root}/_{part:06d}-{len(made):06d}-{task.taskAttemptId()}"
            with store.open_output_stream(attempt) as out:
                out.write(file_image(doc_ids, ids, part, len(made)))
            store.move(attempt, name)
            made.append((len(ids), held))

        for batch in slices(batches, ARROW_ROWS):
            for doc_id, code in zip(batch.column(0).to_pylist(), one.encode_ended(batch.column(1), end_id)[0].to_pylist(), strict=True):
                if ids and held + len(code) // 4 > file_tokens:
                    flush()
                    doc_ids, ids, held = [], [], 0
                doc_ids.append(doc_id)
                ids.append(code)
                held += len(code) // 4
        if ids:
            flush()
        yield pa.record_batch(
            [pa.array([part] * len(made), pa.int32()), pa.array(range(len(made)), pa.int32()),
             pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64())],
            ["part", "k", "n_docs", "n_tokens"])

    spark = documents.sparkSession
    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Rows without an id, or with one id, may be many: they are dealt by their text.
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = narrow.repartitionByRange(partitions_for(documents), *order).sortWithinPartitions(*order)
    ordered.mapInArrow(write, _MADE).write.mode("overwrite").parquet(f"{folder}/manifest")
    made = spark.read.schema(_MADE).parquet(f"{folder}/manifest")
    totals = made.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = W.partitionBy("part").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    return made.join(prefix_bases(totals, "part", "total", "before"), "part").select(
        "part", "k", "n_docs", "n_tokens",
        (F.col("before") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("base"))


def read_codes(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (tokens of all documents before
    it), ``n_tokens`` and ``ids_crc32`` of its ids as unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            content = batch.column(0)[0].as_py()
            one = TokenFile(lambda at, n, content=content: content[at:at + n])
            doc_ids, null, first = one.documents()
            ids = one.all_ids().tobytes()
            stop = np.append(first[1:], one.n_tokens)
            yield pa.record_batch(
                [pa.array(np.full(len(first), one.part, "i4")), pa.array(np.full(len(first), one.k, "i4")),
                 pa.array(doc_ids, pa.int64(), mask=null.astype(bool)), pa.array(first), pa.array(stop - first),
                 pa.array([zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(first, stop, strict=True)], pa.int64())],
                ["part", "k", "doc_id", "first", "n_tokens", "ids_crc32"])

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(f"{folder}/files")
    rows = images.select("content").mapInArrow(
        read, "part int, k int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return rows.join(manifest.select("part", "k", "base"), ["part", "k"]).select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(positions: DataFrame, folder: str, manifest: DataFrame) -> DataFrame:
    """The ids at global token positions: rows of ``position`` gain ``id``.

    Reads a few bytes of a file per position.  Positions past the end are left out.
    """
    files = f"{folder}/files"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(files)
        opened: dict = {}
        for batch in batches:
            ids = []
            for part, k, i in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
                if (part, k) not in opened:
                    for one in opened.values():
                        one.close()
                    opened = {(part, k): store.open_input_file(f"{root}/{part:06d}-{k:06d}.dac")}
                source = opened[part, k]
                ids.append(TokenFile(lambda at, n, source=source: source.read_at(n, at))[i])
            yield pa.record_batch([batch.column(3), pa.array(ids, pa.int64())], ["position", "id"])

    # Positions are dealt to files by cells of fixed width; a file covers a run of cells.
    cell = 1 << 20
    covers = manifest.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("base") / cell), F.floor((F.col("base") + F.col("n_tokens") - 1) / cell))))
    asked = positions.select(F.col("position").cast("long")).withColumn("cell", F.floor(F.col("position") / cell))
    inside = F.col("position").between(F.col("base"), F.col("base") + F.col("n_tokens") - 1)
    found = asked.join(covers, "cell").where(inside).select(
        "part", "k", (F.col("position") - F.col("base")).alias("i"), "position")
    return found.sortWithinPartitions("part", "k").mapInArrow(read, "position long, id long")
