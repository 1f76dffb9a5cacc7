"""Which training documents hold passages of the test items: a positional inverted index.

The index stores postings (term, document row, position).  A phrase is looked up from its
rarest terms: the list of the rarest one, moved back by the term's place in the phrase,
gives the places where the phrase could start; the list of the next one, moved back by its
own place, is intersected with those, and so on for ``LISTS`` lists.  What is left is held
against the text itself.  Rarity is the number of occurrences in all documents, and only
the lists that some phrase is looked up by are stored.

All of it is DataFrame operations; the text passes through one split per use and no Python.

Words are runs of characters other than ASCII ones that are neither letters nor digits,
A-Z lower-cased.  A document row is identified by a hash of its id and text, so rows
that repeat an id are told apart by their text, and rows equal in both share their result;
a null id is a value like any other.  A null or empty text has no words and no hits.  A
test item without words has no windows; a repeated item id collects the windows of all its
rows; items without an id are looked up, but cannot be named in the list of items.  Empty
tables on either side give no hits.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.llm.shared import ascii_lower, holding, small, written

WINDOW = 10
LISTS = 3
# Of a table of phrases, which grows with the test items: two are broadcast at once, and the
# driver holds each several times over while it is sent.
PHRASE_BYTES = 8 << 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), _BREAK), "")


def numbered(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the row's identity, ``row`` and ``twin``.

    Lists hold ``row`` alone: should two rows share it, their candidates are read from both
    texts.  Matches are exact, and from there on both halves count, 128 bits.
    """
    narrow = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.withColumns(identity(F.col("doc_id"), F.col("text")))


def identity(doc_id: Column, text: Column) -> dict[str, Column]:
    return {"row": F.xxhash64(doc_id, text), "twin": F.xxhash64(F.lit("twin"), text, doc_id)}


def phrases(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of the items as ``phrase``, ``terms``; and which item has which:
    ``phrase``, ``item_id``.  An item of fewer words is one window."""
    split = items.select("item_id", words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("at")
    each = split.select("item_id", "words", starts).select("item_id", F.slice("words", F.col("at") + 1, window).alias("terms"))
    keyed = written(each.withColumn("phrase", F.md5(F.array_join("terms", " "))), "test-windows")
    return keyed.select("phrase", "terms").dropDuplicates(["phrase"]), keyed.select("phrase", "item_id").distinct()


def occurrences(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, row, pos) of the ``terms`` in the documents."""
    every = rows.select("row", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return every.join(small(terms), "term").select("term", "row", "pos")


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    return written(occurrences(rows, terms).groupBy("term").agg(F.count("*").alias("n")), "term-counts")


def by_rarity(wanted: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """The phrases all of whose terms occur, with ``lookups``: their ``lists`` rarest terms
    (struct of n, offset, term), rarest first, each term once."""
    each = wanted.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    found = each.join(counts, "term")
    once = found.groupBy("phrase", "length", "term", "n").agg(F.min("offset").alias("offset"), F.count("*").alias("times"))
    ranked = once.groupBy("phrase", "length").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))), 1, lists).alias("lookups"),
        F.sum("times").alias("present"))
    return ranked.where("present = length").select("phrase", "lookups").join(wanted, "phrase")


def postings(rows: DataFrame, looked_up: DataFrame) -> DataFrame:
    """The stored index: the lists of the terms that ``looked_up`` phrases need."""
    terms = looked_up.select(F.explode("lookups.term").alias("term")).distinct()
    return written(occurrences(rows, terms).distinct(), "postings")


def candidate_starts(index: DataFrame, looked_up: DataFrame, lists: int = LISTS) -> DataFrame:
    """(phrase, row, start) where the looked-up terms of a phrase stand as in the phrase."""
    def lookup(k: int) -> Column:
        return F.get("lookups", F.lit(k))

    first = looked_up.select("phrase", "lookups", lookup(0)["term"].alias("term"), lookup(0)["offset"].alias("offset"))
    told = small(first, size=PHRASE_BYTES)
    # Beyond that, only the lists of the rarest terms are shuffled.
    rarest = index if told is not first else holding(index, first, "term")
    left = rarest.join(told, "term").select(
        "phrase", "lookups", "row", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    for k in range(1, lists):
        asked = left.withColumns({"term": lookup(k)["term"], "pos": F.col("start") + lookup(k)["offset"]})
        # A phrase of fewer terms keeps its candidates.
        done = asked.where("term IS NULL").select("phrase", "lookups", "row", "start")
        met = asked.join(index, ["term", "row", "pos"]).select("phrase", "lookups", "row", "start")
        left = met.unionByName(done)
    return left.select("phrase", "row", "start")


def phrase_matches(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact matches of the phrases: (row, twin, doc_id, phrase, start, length)."""
    terms = wanted.select(F.explode("terms").alias("term")).distinct()
    looked_up = written(by_rarity(wanted, term_counts(rows, terms)), "lookups")
    index = postings(rows, looked_up)
    starts = written(candidate_starts(index, looked_up).join(small(wanted, size=PHRASE_BYTES), "phrase"), "candidates")
    texts = rows.join(small(starts.select("row").distinct()), "row", "left_semi").distinct().select(
        "row", "twin", "doc_id", words_of(F.col("text")).alias("words"))
    same = F.slice("words", F.col("start") + 1, F.size("terms")) == F.col("terms")
    held = starts.join(texts, "row").where(same)
    return held.select("row", "twin", "doc_id", "phrase", "start", F.size("terms").alias("length"))


def proximity_matches(rows: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """Where all of a query's terms stand within ``slop`` words of an occurrence of its
    rarest: (row, query, pos, first, last), from ``queries`` of (query, terms).

    ``first`` and ``last`` bound the nearest occurrences of the others.  Positions are met
    by cells of ``slop`` words, so lists are joined by key, not paired.  A query's terms are
    a set: one given twice need not stand twice.
    """
    width = max(slop, 1)
    wanted = queries.select(F.col("query").alias("phrase"), F.array_distinct("terms").alias("terms"))
    terms = wanted.select(F.explode("terms").alias("term")).distinct()
    most = 1 << 20
    looked_up = written(by_rarity(wanted, term_counts(rows, terms), most), "lookups")
    index = postings(rows, looked_up)
    each = looked_up.select("phrase", F.size("lookups").alias("parts"), F.posexplode("lookups").alias("rank", "lookup"))
    lists = index.join(each.select("phrase", "parts", "rank", F.col("lookup.term").alias("term")), "term")
    near = lists.where("rank = 0").select("phrase", "parts", "row", F.col("pos").alias("at")).withColumn(
        "cell", F.explode(F.sequence(F.floor((F.col("at") - slop) / width), F.floor((F.col("at") + slop) / width))))
    other = lists.where("rank > 0").select("phrase", "rank", "row", "pos", F.floor(F.col("pos") / width).alias("cell"))
    met = near.join(other, ["phrase", "row", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    nearest = met.groupBy("phrase", "parts", "row", "at", "rank").agg(
        F.min_by("pos", F.struct(F.abs(F.col("pos") - F.col("at")), "pos")).alias("pos"))
    spans = nearest.groupBy("phrase", "parts", "row", "at").agg(
        F.count("*").alias("found"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    single = lists.where("parts = 1").select(
        "row", F.col("phrase").alias("query"), "pos", F.col("pos").alias("first"), F.col("pos").alias("last"))
    return spans.where("found = parts - 1").select(
        "row", F.col("phrase").alias("query"), F.col("at").alias("pos"),
        F.least("low", "at").alias("first"), F.greatest("high", "at").alias("last")).unionByName(single)


def contaminated(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``documents``: ``doc_id``, ``n_words``, ``n_hit`` (words inside matches),
    ``items`` (ids of the items with matches, as strings in order) and ``row``."""
    rows = numbered(documents)
    wanted, owners = phrases(items, window)
    hits = written(phrase_matches(rows, wanted), "matches")
    whose = ["row", "twin"]
    before = W.partitionBy(*whose).orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.select(*whose, "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    fresh = spans.withColumn("upto", F.coalesce(F.max("stop").over(before), F.lit(0)))
    n_hit = fresh.groupBy(*whose).agg(F.sum(F.greatest(
        F.col("stop") - F.greatest("start", "upto"), F.lit(0))).cast("long").alias("n_hit"))
    named = hits.select(*whose, "phrase").distinct().join(owners, "phrase").groupBy(*whose).agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    n_words = F.size(words_of(F.col("text"))).cast("long").alias("n_words")
    return rows.select("doc_id", n_words, *whose).join(n_hit, whose, "left").join(named, whose, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "row")


def keep_uncontaminated(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` with all their columns, without those that hold a window of an item."""
    wanted, _ = phrases(items, window)
    hit = written(phrase_matches(numbered(documents), wanted).select(
        F.col("row").alias("hit_row"), F.col("twin").alias("hit_twin")).distinct(), "matches")
    own = identity(documents["doc_id"], documents["text"].cast("string"))
    return documents.join(small(hit), (own["row"] == hit["hit_row"]) & (own["twin"] == hit["hit_twin"]), "left_anti")
