"""Balanced label propagation: linked documents end up in the same shard, shards stay even.

Documents are nodes; a link is a hub that its documents belong to (all documents of equal
text share a hub, a single link is a hub of two), so a group of n documents has n rows and
not n * n links.  Every document starts in a shard by its hash.  In a round

1. each hub counts its documents by shard,
2. each document adds up its hubs' counts and wishes to move to the shard with most
   (ties by a hash of its first hub, so that its neighbours choose alike),
3. the wishes, summed up by pair of shards, are held against quotas: what two shards want to
   swap may move, and beyond that what the target has room for,
4. the permitted share of each pair moves, chosen by a hash of the first hub, so
   neighbours move together.

Groups of equal text are settled around that.  One that is larger than a share is dealt into
sub-hubs of a share before the rounds (the last has the rest), so it is cut as few times as can
be.  The rounds move parts of groups and may leave some cut, or a shard too full, so
afterwards whole groups are packed, largest first: into the shard that has most of the group if it
has room, else into the fullest one that has.  Only a group that no shard has room for
is dealt over what room is left; there are fewer of these than shards.  (Packing is hard: where
groups of about a share leave no room, another order might have cut one less.)

Documents without neighbours never wish; they fill up the shards at the end.  At the end
every shard is numbered with linked documents first, and what exceeds an even share goes
to the shards that lack some: sizes are then at most one apart, exactly.

What passes through the driver is 16 x 16 sums, and the number of groups by size and shard. A
hub that holds more than an even share of rows is dealt over several tasks in every join and
numbering.

Defined cases: a null text counts as empty (size 1); rows that repeat a document are
documents of their own; null ids are placed like others; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.llm.shared import small, written
from parley.plans.skew import spread_join

SHARDS = 16
ROUNDS = 6
BUCKET = 50_000  # rows that are numbered in one window
CELL = 10_000  # groups of one size that are packed together


def _fraction(*columns) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def _counts(placed: DataFrame, members: DataFrame, shards: int) -> DataFrame:
    """Per hub: ``n`` and the number of its documents in each shard."""
    here = members.join(placed.select("node", "shard"), "node")
    return here.groupBy("hub").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("shard") == s).alias(f"c{s}") for s in range(shards)))


def _wishes(placed: DataFrame, members: DataFrame, shards: int) -> DataFrame:
    counts = written(_counts(placed, members, shards), "shard-counts")
    seen = spread_join(members, counts, "hub", ["node"])
    total = seen.groupBy("node").agg(F.count("*").alias("hubs"), *(F.sum(f"c{s}").alias(f"c{s}") for s in range(shards)))
    told = total.join(placed, "node")
    # Every hub has counted the document itself; once is enough to make it stay on a tie.
    itself = F.col("hubs") - 1
    # Most documents first; ties as the first hub's hash has it.
    best = F.array_max(F.array(*(
        F.struct((F.col(f"c{s}") - F.when(F.col("shard") == s, itself).otherwise(0)).alias("n"), F.xxhash64("leader", F.lit(s)).alias("tie"), F.lit(s).alias("shard"))
        for s in range(shards))))["shard"]
    return told.select("node", "leader", "shard", best.alias("wish"))


def _permitted(wished: dict[tuple[int, int], int], sizes: list[int], capacity: list[int]) -> dict[tuple[int, int], float]:
    """The share of each pair's wishes that may move."""
    shares = {}
    room = [max(0, c - n) for c, n in zip(capacity, sizes, strict=True)]
    rest: dict[tuple[int, int], int] = {}
    for (s, t), n in wished.items():
        swap = min(n, wished.get((t, s), 0))
        shares[s, t] = swap
        rest[s, t] = n - swap
    for t, free in enumerate(room):
        asked = sum(n for (_, to), n in rest.items() if to == t)
        for (s, to), n in rest.items():
            if to == t and asked:
                shares[s, to] += n * min(1.0, free / asked)
    return {pair: share / wished[pair] for pair, share in shares.items()}


def propagate(nodes: DataFrame, members: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``nodes`` (node, unique) with ``shard``, ``leader`` (the node's first hub, null if
    it has no neighbours); ``members`` are rows of (node, hub)."""
    spark = nodes.sparkSession
    leaders = members.groupBy("node").agg(F.min("hub").alias("leader"))
    placed = written(nodes.join(leaders, "node", "left").withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")), "shards")
    total = nodes.count()
    capacity = _even(total, shards)
    for number in range(rounds):
        linked = placed.where("leader IS NOT NULL")
        wishes = written(_wishes(linked, members, shards).withColumn("round", F.lit(number)), "shard-wishes")
        flows = {(r.shard, r.wish): r.n for r in wishes.groupBy("shard", "wish").agg(F.count("*").alias("n")).collect()}
        wished = {pair: n for pair, n in flows.items() if pair[0] != pair[1]}
        if not wished:
            break
        sizes = [sum(n for (s, _), n in flows.items() if s == shard) for shard in range(shards)]
        shares = _permitted(wished, sizes, capacity)
        allowed = spark.createDataFrame([(s, t, x) for (s, t), x in shares.items()], "shard int, wish int, share double")
        moved = wishes.join(F.broadcast(allowed), ["shard", "wish"]).where(
            _fraction("leader", F.lit(number)) < F.col("share")).select("node", "wish")
        placed = written(placed.join(moved, "node", "left").withColumn(
            "shard", F.coalesce("wish", "shard")).drop("wish"), "shards")
    return placed


def numbered(rows: DataFrame, shard: str, order: list[str], hot: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``slot``, their place in their shard: linked rows by ``leader``, then
    the others; numbers are given per bucket of rows and put together by the buckets' sums.

    ``hot`` has the leaders whose rows need several buckets, and how many (``salts``).
    """
    buckets = max(1, -(-total // BUCKET))
    by = F.coalesce("leader", "node")
    dealt = rows.join(small(hot), "leader", "left").select(
        "*",
        F.when(F.col("leader").isNull(), 1).otherwise(0).alias("k1"),
        F.floor(_fraction(by) * buckets).cast("int").alias("k2"),
        F.when(F.col("salts").isNotNull(), F.col("leader")).alias("k3"),
        F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")), F.lit(0)).cast("int").alias("k4")).drop("salts")
    keys = ["k1", "k2", "k3", "k4"]
    sizes = dealt.groupBy(shard, *keys).agg(F.count("*").alias("size"))
    before = W.partitionBy(shard).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(shard, *keys, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy(shard, *keys).orderBy("leader", *order)
    placed = dealt.withColumn("number", F.row_number().over(within)).alias("d")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [shard, *keys]]
    condition = same[0]
    for x in same[1:]:
        condition = condition & x
    joined = placed.join(bases.alias("b"), condition)
    return joined.select(*(F.col(f"d.{c}") for c in rows.columns), (F.col("b.base") + F.col("d.number") - 1).alias("slot"))


def _places(rows: DataFrame, groups: DataFrame, width: int, total: int) -> DataFrame:
    """``rows`` (node, leader) with ``slot``, their place in their group; ``groups`` (leader, n)."""
    hot = groups.where(F.col("n") > width).select("leader", F.ceil(F.col("n") / width).cast("int").alias("salts"))
    return numbered(rows.select("node", "leader"), "leader", ["node"], hot, total)


def _even(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _width(total: int, shards: int) -> int:
    """Rows of a large group that are numbered in one window."""
    return min(BUCKET, max(1000, total // shards // 16))


def sub_hubs(members: DataFrame, groups: DataFrame, total: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """``members`` (node, hub) and ``groups`` (hub, n), hubs larger than a share dealt into
    sub-hubs of a share."""
    share = max(1, total // shards)
    large = groups.where(F.col("n") > _even(total, shards)[0]).withColumnRenamed("hub", "leader")  # fewer than shards
    if not large.limit(1).count():
        return members, groups
    own = F.broadcast(large.select(F.col("leader").alias("hub")))
    slots = _places(members.join(own, "hub", "left_semi").withColumnRenamed("hub", "leader"), large, _width(total, shards), total)
    part = F.concat_ws("/", "leader", F.floor(F.col("slot") / share).cast("string")).alias("hub")
    parts = large.select("leader", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / share))).alias("part"))
    sizes = parts.select(
        F.concat_ws("/", "leader", F.col("part").cast("string")).alias("hub"),
        F.least(F.lit(share).cast("long"), F.col("n") - F.col("part") * share).alias("n"))
    return (written(members.join(own, "hub", "left_anti").select("node", "hub").unionByName(slots.select("node", part)), "shard-members"),
            written(groups.join(own, "hub", "left_anti").select("hub", "n").unionByName(sizes), "shard-hubs"))


def packed(cells: list[tuple[int, int, int, int]], capacity: list[int]) -> tuple[list[tuple], list[int]]:
    """Where groups go: ``cells`` of (size, shard, cell, groups) become ranges (size, shard,
    cell, first, behind, to) of a cell's groups, ``to`` None where no shard has room for one;
    and the room left."""
    def attempt(stay: bool) -> tuple[list[tuple], list[int], int]:
        room, ranges, lost = list(capacity), [], 0
        sizes = defaultdict(list)
        for size, shard, cell, n in sorted(cells):
            sizes[size].append((shard, cell, n))
        for size in sorted(sizes, reverse=True):
            rest = []
            for shard, cell, n in sizes[size]:
                k = min(n, room[shard] // size) if stay else 0
                room[shard] -= k * size
                if k:
                    ranges.append((size, shard, cell, 0, k, shard))
                if k < n:
                    rest.append((shard, cell, k, n))
            for shard, cell, at, n in rest:
                while at < n:
                    to = min((s for s in range(len(room)) if room[s] >= size), key=lambda s: room[s], default=None)
                    k = n - at if to is None else min(n - at, room[to] // size)
                    ranges.append((size, shard, cell, at, at + k, to))
                    at += k
                    if to is None:
                        lost += k * size
                    else:
                        room[to] -= k * size
        return ranges, room, lost

    kept = attempt(True)
    best = kept if not kept[2] else min(kept, attempt(False), key=lambda x: x[2])
    return best[:2]


def settled(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """``placed`` (node, leader, shard; a node has one hub at most) with every hub in one
    shard, none above an even share, as far as the hubs can be packed."""
    spark = placed.sparkSession
    linked = placed.where("leader IS NOT NULL")
    here = linked.groupBy("leader", "shard").agg(F.count("*").alias("n"))
    hubs = written(here.groupBy("leader").agg(
        F.sum("n").alias("n"), F.max_by("shard", F.struct("n", F.xxhash64("leader", "shard"))).alias("shard")), "shard-groups")
    many = [(r.n, -(-r["count"] // CELL)) for r in hubs.groupBy("n").count().collect()]
    if not many:
        return placed
    cells = small(spark.createDataFrame(many, "n long, cells int"))
    celled = written(hubs.join(cells, "n").withColumn(
        "cell", F.floor(_fraction("leader", F.lit("cell")) * F.col("cells")).cast("int")).drop("cells"), "shard-groups")
    keys = ["n", "shard", "cell"]
    counts = [tuple(r) for r in celled.groupBy(*keys).count().collect()]
    ranges, room = packed(counts, _even(total, shards))
    plan = spark.createDataFrame(ranges, "n long, shard int, cell int, first long, behind long, to int")
    whole = plan.join(spark.createDataFrame(counts, "n long, shard int, cell int, groups long"), keys).where(
        "first = 0 AND behind = groups").select(*keys, F.col("to").alias("all_to"), F.lit(True).alias("together"))
    known = celled.join(small(whole), keys, "left")
    # Only the groups of a cell that goes to several shards are numbered.
    within = W.partitionBy(*keys).orderBy(F.xxhash64("leader"), "leader")
    apart = known.where("together IS NULL").withColumn("number", F.row_number().over(within) - 1).join(small(plan), keys).where(
        "number >= first AND number < behind").select("leader", "n", "to")
    to = written(known.where("together").select("leader", "n", F.col("all_to").alias("to")).unionByName(apart), "shard-targets")
    together = spread_join(linked.select("node", "leader"), to.where("to IS NOT NULL").withColumnRenamed("to", "shard"), "leader", ["node"])
    found = placed.where("leader IS NULL").unionByName(together.select(placed.columns))
    cut = to.where("to IS NULL").select("leader", "n")  # fewer than shards
    spans = []
    for r in sorted(cut.collect(), key=lambda r: (-r.n, r.leader)):
        at = 0
        while at < r.n:
            s = max(range(shards), key=lambda s: room[s])
            k = min(r.n - at, room[s])
            spans.append((r.leader, at, at + k, s))
            room[s] -= k
            at += k
    if spans:
        rows = linked.join(F.broadcast(cut.select("leader")), "leader", "left_semi")
        span = spark.createDataFrame(spans, "leader string, first long, behind long, shard int")
        dealt = _places(rows, cut, _width(total, shards), total).join(F.broadcast(span), "leader").where("slot >= first AND slot < behind")
        found = found.unionByName(dealt.select(placed.columns))
    return written(found, "shard-settled")


def even_rows(placed: DataFrame, hubs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``placed`` with every shard brought to an even share: ``shard`` and ``slot``, gapless
    from 0.  ``hubs`` has the rows of each leader as (leader, n)."""
    sizes = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    total = sum(sizes.values())
    even = _even(total, shards)
    hot = hubs.where(F.col("n") > BUCKET).select("leader", F.ceil(F.col("n") / BUCKET).cast("int").alias("salts"))
    rows = written(numbered(placed, "shard", ["node"], hot, total), "shard-slots")
    excess, lack, filled = [0], [0], []
    for s in range(shards):
        n = sizes.get(s, 0)
        filled.append(min(n, even[s]))
        excess.append(excess[-1] + max(0, n - even[s]))
        lack.append(lack[-1] + max(0, even[s] - n))

    def of(values: list[int], index) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), index + 1)

    over = F.col("slot") >= of(even, F.col("shard"))
    rank = of(excess, F.col("shard")) + F.col("slot") - of(even, F.col("shard"))
    bins = F.array(*(F.lit(v).cast("long") for v in lack[1:]))
    to = F.size(F.filter(bins, lambda x: x <= F.col("rank"))).cast("int")
    ranked = rows.withColumn("rank", F.when(over, rank)).withColumn("to", F.when(over, to))
    return ranked.withColumns({
        "slot": F.when(over, of(filled, F.col("to")) + F.col("rank") - of(lack, F.col("to"))).otherwise(F.col("slot")),
        "shard": F.when(over, F.col("to")).otherwise(F.col("shard")).cast("int")}).drop("rank", "to")


def shard_documents(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``documents``: ``doc_id``, ``size`` (bytes of the text and 1),
    ``text_crc32``, ``shard`` and ``slot``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("hub"))
    # Rows equal in id and text are one kind; its rows are told apart by their number in it.
    kinds = told.groupBy("doc_id", "hub").agg(
        F.count("*").alias("times"), F.first("size").alias("size"), F.first("text_crc32").alias("text_crc32"))
    rows = written(kinds.select(
        "doc_id", "hub", "size", "text_crc32", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
    ).withColumn("node", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "hub", "copy")), "shard-rows")
    groups = written(rows.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"), "shard-hubs")
    members = written(spread_join(rows.select("node", "hub"), groups, "hub", ["node"]), "shard-members")
    total = rows.count()
    members, groups = sub_hubs(members, groups, total, shards)
    placed = settled(propagate(rows.select("node"), members, shards, rounds), total, shards)
    even = even_rows(placed, groups.withColumnRenamed("hub", "leader"), shards)
    return rows.join(even.select("node", "shard", "slot"), "node").select(
        "doc_id", "size", "text_crc32", "shard", "slot")
