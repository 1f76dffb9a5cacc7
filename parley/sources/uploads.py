"""Uploaded files as a data source: ``spark.read.format("uploads")``.

Files are dealt into partitions by their sizes, so a task reads about as many bytes as any
other however sizes differ.  Conditions on ``size`` and ``name`` are answered from the
listing: a file that fails one is never opened.
"""

from __future__ import annotations

import operator
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as ds

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, name string, size long, content binary"
PARTITION_BYTES = 64 << 20
_BATCH_BYTES = 16 << 20

_TESTS = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le,
    ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: operator.contains,
    ds.In: lambda value, listed: value in listed,
}


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Files(ds.InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        super().__init__(None)
        self.files = files


def dealt(files: Iterable[tuple[str, str, int]], most: int) -> list[list[tuple[str, str, int]]]:
    """Files (path, name, size) in order, in groups of ``most`` bytes; a larger file is alone."""
    groups, held = [], 0
    for file in files:
        if not groups or held + file[2] > most:
            groups.append([])
            held = 0
        groups[-1].append(file)
        held += file[2]
    return groups


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.tests = path, most, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for given in filters:
            kind, negated = given, isinstance(given, ds.Not)
            if negated:
                kind = given.child
            known = {"name": 1, "size": 2}.get(".".join(getattr(kind, "attribute", ())))
            if type(kind) in _TESTS and known is not None:
                self.tests.append((known, _TESTS[type(kind)], kind.value, negated))
            elif not isinstance(given, ds.IsNotNull) or known is None:
                yield given

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = file_system(self.path)
        listed = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.base_name, i.size) for i in listed if i.is_file and i.base_name[:1] not in "._")
        passed = [f for f in files if all(bool(test(f[k], value)) != negated for k, test, value, negated in self.tests)]
        return [Files(group) for group in dealt(passed, self.most)]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            path, name, sizes, content = zip(*held, strict=True)
            return pa.record_batch(
                [pa.array(path), pa.array(name), pa.array(sizes, pa.int64()), pa.array(content, pa.binary())],
                ["path", "name", "size", "content"])

        for path, name, n in partition.files if partition else ():  # there is one without files, too
            if held and size + n > _BATCH_BYTES:
                yield batch()
                held, size = [], 0
            with store.open_input_stream(path) as file:
                held.append((path, name, n, file.read()))
            size += n
        if held:
            yield batch()


class Uploads(ds.DataSource):
    """Options: ``path``, and ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))


def read_uploads(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The files below ``path``: (path, name, size, content)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Uploads)
    return spark.read.format("uploads").option("partition_bytes", partition_bytes).load(path)


def write_files(files: DataFrame, path: str) -> int:
    """Write each row of ``files`` (name, content) as a file below ``path``; their number.

    A task that runs again writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}") as file:
                    file.write(content)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    narrow = files.select("name", F.col("content").cast("binary"))
    return narrow.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
