"""A table as a series of snapshots in hash buckets of its key, of which a batch of changes
rewrites only the buckets it hits.

Under the table's folder:

    version=V/bucket=B   a bucket's rows, as version V left them
    manifest/V.json      for each bucket, the version that holds it; written last

A version that broke off has no manifest and is written again; readers of an earlier
version keep their files, so a table is never overwritten while it is read.  ``tidy``
removes folders that the newest versions do not list.

Changes are folded to a row per key first.  If these are few, they are broadcast and the
table's rows stay where they are read; the table is shuffled only beyond that.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parley.operators.changes import apply_changes
from parley.plans.buckets import BUCKETS, hit_buckets, write_buckets

BROADCAST_KEYS = 500_000


class BucketedTable:
    """The table below ``path`` with the given key and schema (without the bucket)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.at(folder)
        return [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/manifest") if n.endswith(".json"))

    def holders(self, version: int | None = None) -> dict[int, int]:
        """The version that holds each bucket with rows, as of ``version`` or the newest one."""
        known = self.versions()
        if not known:
            return {}
        stream = self.files.open(self.at(f"{self.path}/manifest/{known[-1] if version is None else version}.json"))
        try:
            return {int(b): v for b, v in json.loads(bytes(stream.readAllBytes()).decode()).items()}
        finally:
            stream.close()

    def _list(self, version: int, holders: dict[int, int]) -> None:
        final, draft = (self.at(f"{self.path}/manifest/{version}.{end}") for end in ("json", "draft"))
        stream = self.files.create(draft, True)
        stream.write(bytearray(json.dumps(holders).encode()))
        stream.close()
        if not self.files.rename(draft, final):
            raise FileExistsError(f"version {version} of {self.path} is there already")

    def _write(self, rows: DataFrame, version: int) -> list[int]:
        """Write rows as a version; the buckets that have any."""
        folder = f"{self.path}/version={version}"
        write_buckets(rows, folder, self.key, "overwrite", self.buckets)
        return [int(n.split("=")[1]) for n in self._names(folder) if n.startswith("bucket=")]

    def create(self, rows: DataFrame) -> None:
        if self.versions():
            raise FileExistsError(self.path)
        self._list(0, {b: 0 for b in self._write(rows.select(*self.schema.names), 0)})

    def read(self, hit: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table's rows; of the buckets in ``hit`` alone, from their files alone."""
        paths = [
            f"{self.path}/version={v}/bucket={b}" for b, v in sorted(self.holders(version).items()) if hit is None or b in hit
        ]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def apply(self, changes: DataFrame, now, order: list[str]) -> DataFrame:
        """Make the next version by ``operators.changes.apply_changes``; returns the changes that
        matched nothing.  ``changes`` should be a stored table: it is read several times."""
        known = self.versions()
        (hit,) = hit_buckets(changes, self.key, buckets=self.buckets)
        before = self.holders()
        base = self.read(hit)
        keys = changes.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        snapshot, unmatched = apply_changes(base, changes, self.key, now, order, few)
        version = known[-1] + 1
        written = self._write(snapshot, version)
        self._list(version, {b: v for b, v in before.items() if b not in hit} | {b: version for b in written})
        return unmatched

    def tidy(self, keep: int = 2) -> None:
        """Remove what the newest ``keep`` versions do not list."""
        kept = self.versions()[-keep:]
        held = {(v, b) for k in kept for b, v in self.holders(k).items()}
        for name in self._names(self.path):
            if not name.startswith("version="):
                continue
            version = int(name.split("=")[1])
            for bucket in self._names(f"{self.path}/{name}"):
                if bucket.startswith("bucket=") and (version, int(bucket.split("=")[1])) not in held:
                    self.files.delete(self.at(f"{self.path}/{name}/{bucket}"), True)
        for old in self.versions()[:-keep]:
            self.files.delete(self.at(f"{self.path}/manifest/{old}.json"), False)
