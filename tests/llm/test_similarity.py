import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import contamination, near_duplicates
from pyspark.sql import functions as F

from parley.llm import decontaminate, graph, neardup, shards
from parley.llm.registry import QUERIES


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def groups(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.doc_id].append((r.n_shingles, r.component_id))
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return {d: (sorted(n for n, _ in v), v[0][1]) for d, v in found.items() if len({c for _, c in v}) == 1}


def test_near_duplicates_query(spark, folder):
    want = near_duplicates(rows(spark.read.parquet(f"{folder}/documents.parquet")), 4)
    assert groups(QUERIES["op5_near_duplicates"](spark, folder)) == want


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def crowded(spark):
    """Copies, near copies about the threshold, a group beyond a node's limit, chains of
    links, and a passage that most documents share."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = [rng.choice(vocabulary) for _ in range(12)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))]
        texts += [" ".join(common + base)] + [edited(rng, common + base, rng.randrange(0, 5)) for _ in range(rng.randrange(0, 4))]
    crowd = [rng.choice(vocabulary) for _ in range(300)]
    texts += [edited(rng, crowd, rng.randrange(1, 10)) for _ in range(80)]
    chain = [rng.choice(vocabulary) for _ in range(120)]
    for step in range(25):
        chain[step * 3 % 120] = f"link{step}"
        texts.append(" ".join(chain))
    texts += ["exactly alike " * 40] * 30 + ["too short"] * 3 + ["Too Short"]
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()


def test_few_pairs_are_missed_on_the_deepest_level():
    rng = np.random.default_rng(0)
    shared = rng.binomial(neardup.COORDINATES, 0.8, 4000)
    pick = 1 / 0.8 / neardup.COORDINATES
    met = np.ones((neardup.TREES, 4000), int)
    for _ in range(neardup.LEVELS):
        met = rng.binomial(met * shared, pick)
    assert np.isclose((met == 0).all(0).mean(), neardup.missed(neardup.LEVELS, neardup.TREES), atol=1.5e-3)
    assert neardup.missed(neardup.LEVELS, neardup.TREES) <= 1e-3 < neardup.missed(neardup.LEVELS, 16)


def test_near_duplicates_of_a_crowd(crowded):
    assert groups(neardup.near_duplicates(crowded)) == near_duplicates(sorted(rows(crowded)), 5)


def test_small_nodes_and_few_levels_lose_nothing(crowded, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "LEVELS", 2)
    labels = neardup.similarity_groups
    monkeypatch.setattr(neardup, "similarity_groups", lambda *a: labels(*a, levels=2))
    assert groups(neardup.near_duplicates(crowded, 4)) == near_duplicates(sorted(rows(crowded)), 4)


def test_a_crowd_alike_without_being_linked_is_not_carried_along(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for k in range(700):
        words = [f"w{i}" for i in range(100)]
        for i in rng.sample(range(100), 6):
            words[i] = f"x{k}-{i}"
        texts.append((k, " ".join(words)))
    made = Counter()
    write = neardup.written

    def counted(df, purpose):
        out = write(df, purpose)
        made[purpose] += out.count()
        return out

    monkeypatch.setattr(neardup, "written", counted)
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    assert groups(neardup.near_duplicates(documents, 4)) == near_duplicates(texts, 4)
    # At the roots a class has a row for each tree and child; neither deeper nodes nor what is compared come near twice that.
    roots = 700 * neardup.TREES / 0.8
    assert made["neardup-nodes"] < 1.5 * roots and made["neardup-candidates"] < 2 * roots, made


def test_near_duplicates_odd_rows(odd, none):
    want = near_duplicates([r for r in rows(odd) if r[0] is not None], 5)
    found = neardup.near_duplicates(odd)
    assert found.count() == odd.count()
    got = groups(found)
    (alone,) = [r for r in found.collect() if r.doc_id is None]
    assert alone.component_id is None and alone.kept and got.pop(None)
    assert got == want
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    # The two texts of id 9 are not linked, so both rows stay.
    assert Counter(r.doc_id for r in kept.collect()) == Counter({None: 1} | {want[d][1]: 1 for d in want} | {9: 2})
    assert neardup.keep_one(none).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    words = [" ".join(f"{w}{i}" for i in range(40)) for w in "abc"]
    rows = [(9, words[0]), (9, words[1]), (12, words[0]), (12, words[2] + " more"), (3, words[2]), (7, words[1]), (7, words[1])]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id, r.text[0]) for r in neardup.keep_one(documents).collect())
    assert kept == [(3, "c"), (7, "b"), (9, "a")]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(300, 200), (250, 300), (250, 201)]
    rng.shuffle(links)
    found = graph.components(spark.createDataFrame([tuple(sorted(x)) for x in links], "a long, b long"))
    label = {r.u: r.label for r in found.collect()}
    assert {label[i] for i in range(41)} == {0} and {label[i] for i in range(100, 150)} == {100}
    assert {label[i] for i in (200, 201, 250, 300)} == {200}
    labels = graph.Labels(spark)
    labels.link(spark.createDataFrame([(5, 9), (7, 8)], "a long, b long"))
    labels.link(spark.createDataFrame([(8, 9), (1, 2)], "a long, b long"))
    labels.link(spark.createDataFrame([(5, 7)], "a long, b long"))
    got = {r.x: r.label for r in labels.attach(spark.createDataFrame([(i,) for i in range(10)], "x long"), "x").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 5, 8: 5, 9: 5}


# ------------------------------------------------------------------ decontamination

def found_in(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str)


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "same TEXT as the next one word by word"), (2, "word"), (3, None), (4, "..."), (2, "word1 word2 word3"),
         (None, "café"), (5, " ".join(f"word{i}" for i in range(690, 701)) + " word0 word1"), (6, "never seen here")],
        "item_id long, text string").withColumn("words", F.lit(1))
    want = sorted(contamination(rows(odd), [(r.item_id, r.text) for r in items.collect()]), key=str)
    assert found_in(decontaminate.contaminated(odd, items)) == want
    assert decontaminate.contaminated(none, items).count() == 0
    assert {x[2] for x in found_in(decontaminate.contaminated(odd, items.limit(0)))} == {0}
    kept = decontaminate.keep_uncontaminated(odd, items)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)


def test_decontamination_counts_words_by_the_split(spark, capsys):
    texts = ["A1 b-C \u00e9\u00c9x", "--", " \x7f~z", "\U0001F600 q\x00r", "", None]
    documents = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "no such words")], "item_id string, text string")
    found = decontaminate.contaminated(documents, items)
    assert [r.n_words for r in found.orderBy("doc_id").collect()] == [4, 0, 1, 3, 0, 0]
    found.explain("extended")  # one match object a word took half of the query's time
    assert "regexp_extract_all" not in capsys.readouterr().out


def test_phrases_of_common_words(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found_in(got) == sorted(contamination(list(enumerate(texts)), items), key=str)


def test_phrases_beyond_a_few_are_not_broadcast(spark, monkeypatch):
    """54,000 windows: the driver would hold the tables of all of them, twice at once."""
    rng, plans, write = random.Random(5), {}, decontaminate.written
    vocabulary = [f"{''.join(rng.choices('abcdefgh', k=12))}{i}" for i in range(300)]
    texts = [rng.choices(vocabulary, k=1009) for _ in range(54)]
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "item_id long, text string")
    passages = [texts[i][7 * i:7 * i + 10 + i] for i in range(20)]
    docs = [" ".join(vocabulary), *(" ".join(p) for p in passages), " ".join(vocabulary[:9])]
    documents = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")

    def noted(df, purpose):
        plans[purpose] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, purpose)

    monkeypatch.setattr(decontaminate, "written", noted)
    kept = decontaminate.keep_uncontaminated(documents, items)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 21]
    plan = plans["candidates"]
    assert [line for line in plan.splitlines() if "Join Inner" in line and "strategy=broadcast" in line] == []


def test_shuffled_phrases_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", 0)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, ""]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14)))) for i in range(30)] + [(None, "a b"), (3, None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found_in(got) == sorted(contamination(list(enumerate(texts)), items), key=str)


def test_proximity(spark):
    rng = random.Random(4)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 50))] for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    numbered = decontaminate.numbered(docs)
    queries = spark.createDataFrame([("q1", ["a", "b", "c"]), ("q2", ["h"]), ("q3", ["d", "z"])], "query string, terms array<string>")
    got = {(r.doc_id, r["query"], r.pos, r["first"], r["last"]) for r in decontaminate.proximity_matches(
        numbered, queries, 3).join(numbered, "row").collect()}
    counts = Counter(w for t in texts for w in t)
    want = set()
    for name, terms in (("q1", "abc"), ("q2", "h")):
        rarest = min(terms, key=lambda w: (counts[w], w))
        for d, t in enumerate(texts):
            for i in (i for i, w in enumerate(t) if w == rarest):
                spots = [min(((abs(j - i), j) for j, w in enumerate(t) if w == x and abs(j - i) <= 3), default=None)
                         for x in terms if x != rarest]
                if None not in spots:
                    at = [i, *(s[1] for s in spots)]
                    want.add((d, name, i, min(at), max(at)))
    assert {(d, q, i) for d, q, i, *_ in got} == {(d, q, i) for d, q, i, *_ in want}
    assert got == want


def test_proximity_without_slop(spark):
    """Two terms never stand at one place; a term given twice is one."""
    numbered = decontaminate.numbered(spark.createDataFrame([(0, "a b a"), (1, "b")], "doc_id long, text string"))
    queries = spark.createDataFrame([("ab", ["a", "b"]), ("bb", ["b", "b"])], "query string, terms array<string>")
    got = decontaminate.proximity_matches(numbered, queries, 0).join(numbered, "row").collect()
    assert sorted((r.doc_id, r["query"], r.pos) for r in got) == [(0, "bb", 1), (1, "bb", 0)]


# ------------------------------------------------------------------ shards

def check_shards(found, docs, n=16):
    count = Counter(r.shard for r in found)
    sizes = [count.get(s, 0) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(n):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sizes[s]))
    told = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert told == Counter((r.doc_id, r["size"], r.text_crc32) for r in found)
    spread = defaultdict(list)
    for r in found:
        spread[r.text_crc32, r["size"]].append(r.shard)
    return [Counter(s) for s in spread.values() if len(s) > 1]


def test_sharding_query(spark, folder):
    found = QUERIES["op7_sharding"](spark, folder)
    assert {(r.law, r.grown_shard) for r in found.collect()} == {("rows", None)}
    together = check_shards(found.collect(), rows(spark.read.parquet(f"{folder}/documents.parquet")))
    assert sum(len(c) == 1 for c in together) >= 0.9 * len(together)


def test_sharding_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET", 20)
    texts = ["the same"] * 200 + [f"pair {i // 2}" for i in range(100)] + [f"single {i}" for i in range(300)]
    docs = list(enumerate(texts))
    together = check_shards(shards.shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    assert sum(len(c) == 1 for c in together if sum(c.values()) == 2) >= 45


def test_groups_below_a_share_are_whole(spark, monkeypatch):
    """A third of the rows are one text; pairs, fours and groups of nearly a share besides."""
    monkeypatch.setattr(shards, "CELL", 16)
    texts = ["hot"] * 800 + [f"pair {i // 2}" for i in range(600)] + [f"four {i // 4}" for i in range(600)]
    texts += [f"large {i // 140}" for i in range(280)] + [f"single {i}" for i in range(120)]
    docs = list(enumerate(texts))
    together = check_shards(shards.shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    share = len(docs) // 16
    assert all(len(c) == 1 for c in together if sum(c.values()) <= share)
    (hot,) = [c for c in together if sum(c.values()) > share]
    assert len(hot) == -(-800 // share)


def test_groups_without_room_fill_what_is_left(spark):
    """Seventeen groups that together are all rows: sixteen fit whole."""
    docs = [(g * 20 + i, f"group {g}") for g in range(17) for i in range(20)]
    together = check_shards(shards.shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    assert sorted(len(c) > 1 for c in together) == [False] * 16 + [True]


def test_packing_of_groups():
    ranges, room = shards.packed([(6, 0, 0, 2), (4, 0, 0, 2), (3, 1, 0, 1)], [10, 10])
    assert room == [0, 0] and sum(size * (b - a) for size, _, _, a, b, to in ranges if to is None) == 3
    ranges, room = shards.packed([(5, 0, 0, 1), (2, 1, 0, 4)], [7, 7])
    assert min(room) >= 0 and all(r[-1] is not None for r in ranges)


def test_sharding_odd_rows(odd, none):
    check_shards(shards.shard_documents(odd).collect(), rows(odd))
    assert shards.shard_documents(none).count() == 0


def test_propagation_over_links(spark):
    """Eight cliques of links, given pair by pair."""
    pairs = [(c * 10 + i, c * 10 + j) for c in range(8) for i in range(10) for j in range(i)]
    members = spark.createDataFrame(
        [(str(x), f"link{k}") for k, p in enumerate(pairs) for x in p], "node string, hub string")
    nodes = spark.createDataFrame([(str(i),) for i in range(160)], "node string")
    placed = {int(r.node): r.shard for r in shards.propagate(nodes, members, 4, rounds=10).collect()}
    start = {int(r.node): r.shard for r in shards.propagate(nodes, members, 4, rounds=0).collect()}
    cut = sum(placed[a] != placed[b] for a, b in pairs)
    assert cut < 0.5 * sum(start[a] != start[b] for a, b in pairs)


def test_rows_that_share_half_of_their_identity_are_told_apart(spark, monkeypatch):
    from parley.llm import decontaminate

    def half(doc_id, text):
        return {"row": F.lit(7).cast("long"), "twin": F.xxhash64(doc_id, text)}

    monkeypatch.setattr(decontaminate, "identity", half)
    passage = " ".join(f"p{i}" for i in range(12))
    docs = [(1, f"before {passage} after"), (2, "p0 p1 p2 p3 p4 and nothing more"), (3, "clean words only"), (None, passage), (4, None)]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([("i", passage), ("j", "never found in any of the texts that are here at all")], "item_id string, text string")
    found = sorted((r.doc_id or 0, r.n_hit, r["items"]) for r in decontaminate.contaminated(documents, items).collect())
    assert found == [(0, 12, ["i"]), (1, 12, ["i"]), (2, 0, []), (3, 0, []), (4, 0, [])]
    assert sorted(r.doc_id for r in decontaminate.keep_uncontaminated(documents, items).collect()) == [2, 3, 4]
