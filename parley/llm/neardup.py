"""Near-duplicate documents by a chosen-path similarity join.

A document's set holds its distinct word windows.  Documents are linked when
100 * intersection >= 80 * union, and grouped by links.

1. Documents with equal sets form a class; from here on a class stands for its documents.
2. Each class has a signature: its least hash under each of ``COORDINATES`` hash functions.
   A pair (function, least hash) is a token; two classes share a token with a probability
   equal to their similarity.
3. ``TREES`` independent trees branch the classes.  A class goes from a node down to the
   child of each token that the node's hash selects; 1 / threshold of its tokens are
   selected on average, so a linked pair goes down together about once on average, at
   every level, however similar the rest of the node is.
4. A node of ``SMALL`` classes at most is compared exhaustively.  In a larger one all classes
   are compared with its least document (the pivot); if they then are all in one group, the
   node has nothing more to tell.  If not, it is packed into one row and compared
   exhaustively there, as long as it is of two blocks at most (a block: ``BLOCK`` classes,
   ``WEIGHT`` windows); only a larger one is branched further, so a crowd of documents that
   are alike without being linked is not carried through every level of every tree.  What
   is larger still after ``LEVELS`` levels is compared in blocks that meet in pairs, so no
   node is left out and no pair of documents is a row.
   Classes that are in one group already are not compared again.
5. Comparing means: signatures first (pairs that agree in under ``LEAST_AGREE`` of their
   tokens are dropped), then the full sets.  Candidates travel as clusters, one row for each
   member and two blocks or less, not as pairs, and of a cluster's confirmed links only as
   many come out as connect its members.

Recall: a pair at the threshold shares a node of a tree with probability 0.63 on level 1,
0.47 on level 2, 0.37 on level 3, 0.31 on level 4.  All trees branch on one signature, so their
misses are not independent; ``missed`` sums over how many tokens a pair shares.  There are as
many trees as keep it at ``MISSED`` on the deepest level.  Its signatures agree in less than 0.55 of 64 tokens
with probability 2e-6.

Defined cases: null and empty texts, and texts without words, have an empty set and are
linked with nothing.  Rows that repeat a ``doc_id`` are one document with several sets: it
is linked where one of them is.  Rows without a ``doc_id`` stay by themselves (null
``component_id``, kept).  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import count
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.graph import Labels
from parley.llm.shared import slices, small, written
from parley.llm.words import Hasher, mixed, shingle_sets
from parley.plans.skew import spread_join

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
PERCENT = 80
COORDINATES = 64
SMALL = 32
BLOCK = 2048  # classes of a packed block
WEIGHT = 1_000_000  # word windows of a packed block; one document may hold more
TILE = 64  # sets compared at once
LEVELS = 4
MISSED = 1e-3  # at most, of the pairs at the threshold whose nodes are as deep as can be
LEAST_AGREE = 0.55

_SKETCH = "doc_id long, n_shingles long, set_id binary, signature binary, sketch binary"


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """Per row: set size, a 128-bit digest of the set, the signature (32 bits a coordinate)
    and its low bytes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        seeds = mixed(np.arange(1, COORDINATES + 1, dtype="u8"))
        for batch in slices(batches, 256):
            n = batch.num_rows
            hashes, text = shingle_sets(batch.column(1), hasher, width)
            sizes = np.bincount(text, minlength=n)
            some = np.flatnonzero(sizes)
            first = (np.cumsum(sizes) - sizes)[some]
            digest, signature = np.zeros((n, 2), "<u8"), np.zeros((n, COORDINATES), "<u4")
            if len(some):
                digest[some, 0] = np.add.reduceat(mixed(hashes), first)
                digest[some, 1] = np.add.reduceat(mixed(hashes ^ seeds[0]), first)
                for k, seed in enumerate(seeds):
                    least = np.minimum.reduceat(mixed_once(hashes ^ seed), first)
                    signature[some, k] = least >> np.uint64(32)
            low = (signature & 255).astype("u1")
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes.astype("i8")),
                 pa.array([x.tobytes() for x in digest], pa.binary()),
                 pa.array([x.tobytes() for x in signature], pa.binary()),
                 pa.array([x.tobytes() for x in low], pa.binary())],
                ["doc_id", "n_shingles", "set_id", "signature", "sketch"])

    return documents.mapInArrow(sketch, _SKETCH)


def mixed_once(x: np.ndarray) -> np.ndarray:
    """A cheaper bijection, for inputs that are hashes already."""
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93)


def missed(level: int, trees: int, percent: int = PERCENT) -> float:
    """The probability that a pair at the threshold shares no node on ``level`` of any tree."""
    alike, total = percent / 100, 0.0
    for shared in range(COORDINATES + 1):
        meet = 1.0
        for _ in range(level):
            meet = 1 - (1 - meet / alike / COORDINATES) ** shared
        total += comb(COORDINATES, shared) * alike**shared * (1 - alike) ** (COORDINATES - shared) * (1 - meet) ** trees
    return total


TREES = next(n for n in count(1) if missed(LEVELS, n) <= MISSED)


def _children(nodes: np.ndarray, signature: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of (node, signature): the children each goes to, and the row's number."""
    k = np.arange(1, signature.shape[1] + 1, dtype="u8") << np.uint64(32)
    token = mixed(k[None, :] + signature)
    child = mixed(token ^ nodes[:, None])
    chosen = mixed(child ^ np.uint64(0x5DEECE66D)) < np.uint64(int(share * 2**64))
    row, at = np.nonzero(chosen)
    return child[row, at], row


def branch(rows: DataFrame, percent: int, trees: int = 0) -> DataFrame:
    """Rows of (doc_id, signature, n_shingles, node) to the nodes one level down: (node, doc_id, n_shingles).

    With ``trees``, the rows are at the roots of that many trees instead.
    """
    share = 100 / percent / COORDINATES

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mixed(np.arange(1, trees + 1, dtype="u8") << np.uint64(40))
        for batch in slices(batches, 2048):
            signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(batch.num_rows, -1)
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            at = [np.full(len(doc), r, "u8") for r in roots] if trees else [
                batch.column(3).to_numpy(zero_copy_only=False).view("u8")]
            for nodes in at:
                child, row = _children(nodes, signature.astype("u8"), share)
                yield pa.record_batch(
                    [pa.array(child.view("i8")), pa.array(doc[row]), batch.column(2).take(pa.array(row))],
                    ["node", "doc_id", "n_shingles"])

    return rows.mapInArrow(step, "node long, doc_id long, n_shingles long")


def _met(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (node, ...) of the given nodes (node, n, ...), with the nodes' columns.

    A node with more rows than an even share of a partition is broadcast, so its rows stay
    where they are; there are fewer such nodes than partitions.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fair = (nodes.agg(F.sum("n")).first()[0] or 0) / partitions
    light = rows.join(nodes.where(F.col("n") <= fair), "node")
    return light.unionByName(rows.join(F.broadcast(nodes.where(F.col("n") > fair)), "node"))


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of signature bytes that agree, along the last axis."""
    return np.bitwise_count((x == y).view("u8")).sum(-1) / COORDINATES


def _pivot_pairs(rows: DataFrame, nodes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Each class of a larger node with the node's least document, as pairs of members."""
    pivots = written(nodes.where(F.col("n") > SMALL).join(classes.select(
        F.col("doc_id").alias("pivot"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a")), "pivot"),
        "neardup-pivots")
    met = _met(rows.where(F.col("n") > SMALL).select("node", "doc_id", "label"), pivots)
    # Those of one group are not compared again, and trees repeat pairs.
    told = met.where("label <> pivot_label").dropDuplicates(["pivot", "doc_id"]).join(classes.select("doc_id", "n_shingles", "sketch"), "doc_id")
    near_size = F.least("n_a", "n_shingles") * 100 >= F.greatest("n_a", "n_shingles") * percent

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(batch.num_rows, -1) for c in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(_agree(x, y) >= LEAST_AGREE))

    pairs = told.where(near_size).select("pivot", "doc_id", "sketch_a", "sketch").mapInArrow(near, "pivot long, doc_id long")
    return pairs.select(F.array("pivot", "doc_id").alias("members"))


def _clusters(groups: DataFrame, percent: int) -> DataFrame:
    """Of bounded groups of structs (doc_id, label, n, sketch, own), the sets of members that
    may be linked across labels: connected by pairs whose signatures agree enough.  In a
    group from two blocks (``own``) pairs from one are left out; the block itself has them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = []
            for members in batch.column(0):
                members = members.values
                doc, label, n, own = (pc.struct_field(members, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "label", "n", "own"))
                sketch = np.frombuffer(b"".join(pc.struct_field(members, "sketch").to_pylist()), "u1").reshape(len(doc), -1)
                order = np.argsort(doc)
                doc, label, n, own, sketch = doc[order], label[order], n[order], own[order], sketch[order]
                two = (own != own[0]).any()
                group = np.arange(len(doc))
                for i in range(len(doc) - 1):
                    asked = (label[i + 1:] != label[i]) & (100 * np.minimum(n[i + 1:], n[i]) >= percent * np.maximum(n[i + 1:], n[i]))
                    if two:
                        asked &= own[i + 1:] != own[i]
                    at = np.flatnonzero(asked) + i + 1
                    at = at[_agree(sketch[at], sketch[i]) >= LEAST_AGREE]
                    met = np.unique(group[at])
                    if len(met) > 1 or (met != group[i]).any():
                        group[np.isin(group, met) | (group == group[i])] = group[i]
                for g, size in zip(*np.unique(group, return_counts=True), strict=True):
                    if size > 1:
                        found.append(doc[group == g].tolist())
            yield pa.record_batch([pa.array(found, pa.list_(pa.int64()))], ["members"])

    return groups.mapInArrow(gather, "members array<long>")


def _small_nodes(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Exhaustive comparison of nodes of ``SMALL`` classes at most."""
    told = rows.where(F.col("n") <= SMALL).select("node", "doc_id", "label").join(
        classes.select("doc_id", "n_shingles", "sketch"), "doc_id")
    groups = told.groupBy("node").agg(F.collect_list(
        F.struct("doc_id", "label", F.col("n_shingles").alias("n"), "sketch", F.lit(0).alias("own"))).alias("members"))
    return _clusters(groups.select("members"), percent)


def _fits(blocks: int = 2) -> Column:
    return (F.col("n") <= blocks * BLOCK) & (F.col("weight") <= blocks * WEIGHT)


def _blocks(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Exhaustive comparison of large nodes: their classes are packed into one row each, or
    into blocks, and every block meets every other one of its node once."""
    told = rows.select("node", "doc_id", "label", "n", "weight").join(classes.select("doc_id", "n_shingles", "sketch"), "doc_id")
    blocks = F.when(_fits(), 1).otherwise(F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / WEIGHT))).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    packed = told.withColumn("blocks", blocks).withColumn("own", own).groupBy("node", "blocks", "own").agg(F.collect_list(
        F.struct("doc_id", "label", F.col("n_shingles").alias("n"), "sketch", "own")).alias("members"))
    met = written(packed, "neardup-blocks")
    whole = met.where("blocks = 1").select("members")
    others = met.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = others.groupBy("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.flatten(F.collect_list("members")).alias("members")).select("members")
    return _clusters(whole.unionByName(pairs), percent)


def shared_sizes(hashes: np.ndarray, member: np.ndarray, k: int) -> np.ndarray:
    """k x k sizes of the intersections of k sets, given as hashes and their set's number."""
    every, at = np.unique(hashes, return_inverse=True)
    if k * len(every) <= 20_000_000:
        held = np.zeros((k, len(every)), "f4")
        held[member, at] = 1
        return np.rint(held @ held.T).astype("i8")
    sets = [at[member == i] for i in range(k)]
    return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in sets] for x in sets])


def confirmed(candidates: DataFrame, documents: DataFrame, width: int, percent: int, labels: Labels) -> DataFrame:
    """Links (a, b) by the full sets, among the ``members`` of each candidate row: enough of
    them to connect all groups of members that links connect, so fewer than there are groups."""

    def links(rows: pa.RecordBatch, hasher: Hasher) -> pa.RecordBatch:
        """Rows of whole clusters, cluster by cluster."""
        cluster, doc, label = (rows.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3))
        drawn = [shingle_sets(piece.column(2), hasher, width) for piece in slices([rows])]
        hashes = np.concatenate([h for h, _ in drawn])
        size = np.concatenate([
            np.bincount(member, minlength=piece.num_rows) for (_, member), piece in zip(drawn, slices([rows]), strict=True)])
        stop = np.concatenate([[0], np.cumsum(size)])
        edges = np.flatnonzero(np.diff(cluster, prepend=cluster[:1] - 1, append=cluster[-1:] + 1))
        a, b = [], []
        for at, behind in zip(edges, edges[1:], strict=False):
            _, group = np.unique(label[at:behind], return_inverse=True)
            # In order of their groups, so that most tiles of a large group meet for nothing.
            order = np.argsort(group, kind="stable")
            tiles = [order[i:i + TILE] for i in range(0, len(order), TILE)]
            for i, j in zip(*np.triu_indices(len(tiles)), strict=True):
                both = tiles[i] if i == j else np.concatenate([tiles[i], tiles[j]])
                if (group[both] == group[both[0]]).all():
                    continue
                n = size[at + both]
                shared = shared_sizes(
                    np.concatenate([hashes[stop[m]:stop[m + 1]] for m in at + both]), np.repeat(np.arange(len(both)), n), len(both))
                linked = np.triu((100 * shared >= percent * (n[:, None] + n[None] - shared)) & (shared > 0), 1)
                linked &= group[both][:, None] != group[both][None]
                for x, y in both[np.argwhere(linked)]:
                    if group[x] != group[y]:
                        group[group == group[y]] = group[x]
                        a.append(min(doc[at + x], doc[at + y]))
                        b.append(max(doc[at + x], doc[at + y]))
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = Hasher(), None
        for batch in slices(batches):
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            cluster = rows.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(cluster, cluster[-1]))  # the last cluster may go on
            if last:
                yield links(rows.slice(0, last), hasher)
            held = rows.slice(last)
        if held is not None:
            yield links(held, hasher)

    asked = written(candidates.distinct().select(
        F.xxhash64("members").alias("cluster"), F.explode("members").alias("doc_id")), "neardup-candidates")
    times = asked.groupBy("doc_id").agg(F.count("*").alias("n"))
    texts = written(documents.join(small(times), "doc_id"), "neardup-texts")
    # A pivot may be asked for by very many.
    told = spread_join(labels.attach(asked, "doc_id"), texts, "doc_id", ["cluster"])
    # Flat rows, cluster by cluster: a batch then holds so many texts, and not so many clusters.
    sorted_rows = told.select("cluster", "doc_id", "text", "label").repartition("cluster").sortWithinPartitions("cluster")
    found = sorted_rows.mapInArrow(compare, "a long, b long")
    return written(found.where("a <> b").distinct(), "neardup-links")


def similarity_groups(documents: DataFrame, classes: DataFrame, width: int, percent: int,
                      trees: int = TREES, levels: int = LEVELS) -> Labels:
    """The groups of linked classes (doc_id, n_shingles, signature, sketch)."""
    labels = Labels(documents.sparkSession)
    rows = written(branch(classes.select("doc_id", "signature", "n_shingles"), percent, trees), "neardup-nodes")
    for level in range(levels):
        rows = labels.attach(rows, "doc_id")
        nodes = written(_mixed(rows), "neardup-mixed")
        together = written(_met(rows, nodes).select("node", "doc_id", "n_shingles", "label", "n"), "neardup-shared")
        candidates = _small_nodes(together, classes, percent)
        large = not nodes.where(F.col("n") > SMALL).isEmpty()
        if large:
            candidates = candidates.unionByName(_pivot_pairs(together, nodes, classes, percent))
        labels.link(confirmed(candidates, documents, width, percent, labels))
        if not large:
            return labels
        rows = written(labels.attach(together.where(F.col("n") > SMALL).select("node", "doc_id", "n_shingles"), "doc_id"), "neardup-large")
        rest = written(_mixed(rows), "neardup-rest")
        if rest.isEmpty():
            return labels
        # What fits into one row is settled here; at the last level the rest is, too.
        last = level + 1 == levels
        here = _met(rows, rest if last else rest.where(_fits())).select("node", "doc_id", "label", "n", "weight")
        labels.link(confirmed(_blocks(here, classes, percent), documents, width, percent, labels))
        larger = rest.where(~_fits())
        if last or larger.isEmpty():
            return labels
        told = _met(rows, larger).select("node", "doc_id").join(classes.select("doc_id", "signature", "n_shingles"), "doc_id")
        rows = written(branch(told.select("doc_id", "signature", "n_shingles", "node"), percent), "neardup-nodes")
    return labels


def _mixed(rows: DataFrame) -> DataFrame:
    """Nodes whose classes are not all in one group: size, word windows and least document."""
    return rows.groupBy("node").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.min("doc_id").alias("pivot"), F.min_by("label", "doc_id").alias("pivot_label"),
        F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("node", "n", "weight", "pivot", "pivot_label")


def near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): ``doc_id``, ``n_shingles``, ``component_id``
    (least document of its group), ``kept`` (it is that document)."""
    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    drawn = written(sketches(narrow, width), "neardup-sketches")
    some = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(some.groupBy("set_id").agg(
        F.min_by(F.struct("n_shingles", "signature", "sketch"), "doc_id").alias("s"),
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("set_id", "doc_id", "n", "s.*"),
        "neardup-classes")
    same = some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    labels = similarity_groups(narrow, classes, width, percent)
    labels.link(_repeated(some, same, classes))
    of_class = labels.attach(classes.select("set_id", "doc_id", "n"), "doc_id").select(
        "set_id", "n", F.col("label").alias("component_id"))
    placed = spread_join(some.select("doc_id", "n_shingles", "set_id"), of_class, "set_id", ["doc_id"])
    alone = drawn.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = placed.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeated(some: DataFrame, same: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a ``doc_id``."""
    sets = some.join(same.select("doc_id"), "doc_id").select("doc_id", "set_id").distinct()
    of = sets.join(classes.select("set_id", F.col("doc_id").alias("class")), "set_id")
    return of.where("class <> doc_id").select(F.least("class", "doc_id").alias("a"), F.greatest("class", "doc_id").alias("b"))


def keep_one(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``documents`` with all their columns, one row of each group of linked rows only: the one
    with the least ``doc_id``, then the least hash of its text.

    Every row is judged by its own text: of rows that share an id those with other texts
    stay.  Rows without an id stay.
    """
    row, digest = (f"_{name}_{len(documents.columns)}" for name in ("row", "digest"))
    held = written(documents.withColumn(row, F.monotonically_increasing_id()), "neardup-rows")
    known = held.where(F.col("doc_id").isNotNull())
    found = near_duplicates(known.select(F.col(row).alias("doc_id"), "text"), width, percent)
    grouped = written(found.select(F.col("doc_id").alias(row), "component_id").join(
        known.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias(digest)), row), "neardup-grouped")
    best = grouped.groupBy("component_id").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", digest, row)).alias("best")).where("n > 1")
    gone = spread_join(grouped.select("component_id", row), best, "component_id", [row]).where(F.col(row) != F.col(f"best.{row}"))
    return held.join(small(written(gone.select(row), "neardup-gone")), row, "left_anti").select(*documents.columns)
