"""Small tables that grow by a part with every micro-batch, in a bounded number of folders.

A batch adds one run to each table.  ``FANOUT`` runs of one level are folded into a run of the
next, and those of the highest level into one, so there are FANOUT - 1 runs a level at most,
and a row is rewritten once a level.  A table's ``fold`` may shrink rows on the way.

Which runs count after a batch is listed in that batch's manifest, written last.  A batch
starts from the newest manifest before its own, and folders are removed only when neither
its manifest nor that one lists them: a batch that is replayed finds what it found before.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

FANOUT = 4
LEVELS = 4


class Table(NamedTuple):
    schema: str
    fold: Callable[[DataFrame], DataFrame]
    write: Callable[[DataFrame, str], None]


class Run(NamedTuple):
    level: int
    first: int
    last: int

    @property
    def folder(self) -> str:
        return f"run={self.first}-{self.last}"


def next_runs(runs: list[Run], batch: int) -> tuple[list[Run], list[tuple[Run, list[Run]]]]:
    """The runs after ``batch`` and the folds that lead there, each as (new run, its parts)."""
    runs, folds = [*runs, Run(0, batch, batch)], []
    for level in range(LEVELS):
        own = [r for r in runs if r.level == level]
        if len(own) < FANOUT:
            break
        whole = Run(min(level + 1, LEVELS - 1), min(r.first for r in own), max(r.last for r in own))
        folds.append((whole, own))
        runs = [r for r in runs if r.level != level] + [whole]
    return runs, folds


class Tiers:
    """The tables below ``out``, by name."""

    def __init__(self, spark: SparkSession, out: str, tables: dict[str, Table]):
        self.spark, self.out, self.tables = spark, out, tables
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(out).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []

    def _batches(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.out}/manifest") if n.endswith(".json"))

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs that count: after the newest batch, or the newest one before ``before``."""
        batches = [b for b in self._batches() if before is None or b < before]
        if not batches:
            return []
        stream = self.files.open(self.path(f"{self.out}/manifest/{batches[-1]}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return [Run(*r) for r in json.loads(text)]

    def paths(self, name: str, runs: list[Run]) -> list[str]:
        return [f"{self.out}/{name}/{r.folder}" for r in runs]

    def read(self, name: str, runs: list[Run] | None = None) -> DataFrame:
        """A table's rows, folded."""
        table = self.tables[name]
        runs = self.runs() if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], table.schema)
        held = self.spark.read.schema(table.schema).option("basePath", f"{self.out}/{name}")
        return table.fold(held.parquet(*self.paths(name, runs)))

    def commit(self, batch: int, added: dict[str, DataFrame]) -> None:
        """Add a batch's rows to every table, fold what is due, and list the result."""
        before = self.runs(batch)
        after, folds = next_runs(before, batch)
        for name, rows in added.items():
            table = self.tables[name]
            table.write(table.fold(rows), f"{self.out}/{name}/{Run(0, batch, batch).folder}")
            for whole, parts in folds:
                table.write(self.read(name, parts), f"{self.out}/{name}/{whole.folder}")
        self._write_manifest(batch, after)
        self._tidy(batch, before, after)

    def _write_manifest(self, batch: int, runs: list[Run]) -> None:
        at, draft = (self.path(f"{self.out}/manifest/{batch}.{end}") for end in ("json", "draft"))
        stream = self.files.create(draft, True)
        stream.write(bytearray(json.dumps(runs).encode()))
        stream.close()
        self.files.delete(at, False)
        self.files.rename(draft, at)

    def _tidy(self, batch: int, before: list[Run], after: list[Run]) -> None:
        listed = {r.folder for r in (*before, *after)}
        for name in self.tables:
            for folder in self._names(f"{self.out}/{name}"):
                if folder not in listed:
                    self.files.delete(self.path(f"{self.out}/{name}/{folder}"), True)
        for old in [b for b in self._batches() if b < batch][:-1]:
            self.files.delete(self.path(f"{self.out}/manifest/{old}.json"), False)
