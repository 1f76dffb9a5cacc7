"""Importance resampling, repeated strings and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parley.llm import importance, runs, suffixes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# Importance resampling.


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def _plain_importance(docs, target):
    made = [(d, *_features(t)) for d, t in docs]
    raw, wanted = Counter(b for _, f, _ in made for b in f), Counter(b for t in target for b in _features(t)[0])
    s, t = sum(raw.values()) + 10_000, sum(wanted.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * s / ((raw[b] + 1) * t))) for b in raw}
    rows = []
    for d, f, n in made:
        weight, score = sum(gain[b] for b in f), None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(f), weight, score, n))
    able = sorted((r for r in rows if r[0] is not None and r[4] >= 20), key=lambda r: (-r[3], r[0], -r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[:5 * len(able) // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in rows)


def _importance(documents, target):
    found = importance.importance(documents, target)
    return Counter(tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_importance_matches_plain_version(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").repartition(5)
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    want = _plain_importance(_rows(documents), [r.text for r in target.collect()])
    assert sum(r[4] is not None for r in want) >= 5
    assert _importance(documents, target) == want


def test_importance_of_odd_rows(odd, none):
    target = odd.where("doc_id = 1")
    assert _importance(odd, target) == _plain_importance(_rows(odd), [r.text for r in target.collect()])
    assert importance.importance(none, none).count() == 0
    assert _importance(odd, none) == _plain_importance(_rows(odd), [])


def test_many_tied_documents_are_ranked(spark):
    """A third of the rows repeat one id and text: their scores tie, ranks have no gap."""
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(7, text)] * 400 + [(i, f"{text} {i}") for i in range(100, 900)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    drawn = importance.importance(documents, documents.limit(1), percent=50).where("rank IS NOT NULL").collect()
    assert sorted(r.rank for r in drawn) == list(range(1, 601))
    by_rank = sorted(drawn, key=lambda r: r["rank"])
    assert all((-a.score, a.doc_id) <= (-b.score, b.doc_id) for a, b in zip(by_rank, by_rank[1:]))


def test_resampled_documents_keep_their_columns(odd):
    drawn = importance.resampled(odd, odd, percent=100, least_words=1)
    assert drawn.columns == [*odd.columns, "importance_rank"]
    ids = sorted(r.doc_id for r in drawn.collect())
    assert ids == [1, 2, 2, 6, 7, 8, 9, 9]


def test_crcs_of_long_spans():
    data = np.frombuffer(random.Random(3).randbytes(5000), "u1")
    starts, sizes = np.array([0, 10, 4, 700, 0]), np.array([0, 255, 256, 3000, 5000])
    want = [zlib.crc32(data[a:a + n]) for a, n in zip(starts, sizes)]
    assert importance.crc32s(data, starts, sizes).tolist() == want


# Repeated strings.


def _plain_removal(docs, length):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    found = []
    for d, t in texts:
        spans = []
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        ends = [0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)]
        kept = b"".join(t[a:b] for a, b in zip(*ends))
        found.append((d, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return Counter(found)


def _removal(documents, length):
    return Counter(tuple(r) for r in suffixes.digests(suffixes.remove_repeats(documents, length)).collect())


def _pasted(seed, n, letters="abcd ", blocks=12):
    """Texts of random parts and of blocks that many share, whole or in part."""
    rng = random.Random(seed)
    draw = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [draw(rng.randrange(20, 160)) for _ in range(blocks)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            block = rng.choice(shared)
            a = rng.randrange(len(block) // 2)
            parts += [draw(rng.randrange(50)), block if rng.random() < 0.5 else block[a:a + rng.randrange(1, len(block))]]
            if rng.random() < 0.1:
                parts.append(draw(rng.randrange(1, 4)) * rng.randrange(60))
        texts.append("".join(parts))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("partitions", ["1", "9"])
def test_repeated_strings_match_plain_version(spark, seed, partitions):
    """Over few and many buckets; with nine, grams reach over the buckets' ends."""
    docs = _pasted(seed, 150, blocks=(3, 12, 40)[seed])
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        assert _removal(documents, 40) == _plain_removal(docs, 40)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repeated_strings_of_the_table(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    want = _plain_removal(_rows(documents), 400)
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)
    assert _removal(documents, 400) == want


def test_repeated_strings_in_odd_rows(spark, odd, none):
    assert _removal(odd, 30) == _plain_removal(_rows(odd), 30)
    assert suffixes.remove_repeats(none).count() == 0
    texts = [(1, "ü" * 300), (2, "x" * 399), (3, "x" * 400), (4, "y" * 399 + "z"), (5, "z" + "y" * 399), (6, None)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    assert _removal(documents, 400) == _plain_removal(texts, 400)


def test_a_text_longer_than_a_piece(spark, monkeypatch):
    """A text worked on in parts, with a passage that lies over a part's end."""
    rng = random.Random(5)
    draw = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = draw(900)
    texts = [(1, draw(suffixes._PIECE - 400) + passage + draw(5000)), (2, draw(300) + passage), (3, " " * 20_000)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(documents).collect()}
    at = suffixes._PIECE - 400
    assert [tuple(s) for s in got[1].removed] == [(at, at + 900)] and [tuple(s) for s in got[2].removed] == [(300, 1200)]
    assert got[3].kept == b""


def test_quicksort_orders_and_compares():
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(300)]
    padded = [s[:37].ljust(40, b"\0") for s in strings]
    strings = [s[:37] for s in strings]
    order, shared = suffixes.quicksorted(strings, 37)
    assert [padded[i] for i in order] == sorted(padded)
    for a, b, n in zip(order, order[1:], shared[1:]):
        x, y = padded[a][:37], padded[b][:37]
        assert x[:n] == y[:n] and (n == 37 or x[n] != y[n])


# Periodic runs.


def _plain_runs(words):
    codes = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], "i8")
    found = []
    for q in range(1, len(ids) // 4 + 1):
        unequal = np.concatenate([[-1], np.flatnonzero(ids[:-q] != ids[q:]), [len(ids) - q]])
        for k in np.flatnonzero(np.diff(unequal) - 1 + q >= max(6, 4 * q)):
            start, stop = unequal[k] + 1, unequal[k + 1] + q
            part = ids[start:stop]
            if not any(q % p == 0 and (part[p:] == part[:-p]).all() for p in range(1, q)):
                found.append((int(start), int(stop - start), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _plain_collapse(doc, text, plant=True):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if plant and doc is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = _plain_runs(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (doc, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest(),
            hashlib.sha256(rest.encode()).hexdigest())


def _collapse(documents):
    return Counter(tuple(r) for r in runs.digests(runs.find_runs(documents, plant=True)).collect())


def test_runs_match_plain_version(spark):
    rng = random.Random(1)
    docs = []
    for doc in range(600):
        words = []
        for _ in range(rng.randrange(7)):
            unit = [rng.choice(("ab", "abcdefgh")[rng.random() < 0.5]) for _ in range(rng.randrange(1, 7))]
            words += (unit * rng.randrange(1, 9))[:rng.randrange(1, 50)] + [rng.choice("abcdefghijk") for _ in range(rng.randrange(6))]
        docs.append((doc, "\t".join(words)))
    want = Counter(_plain_collapse(*d) for d in docs)
    assert sum(r[1] for r in want) > 500
    assert _collapse(spark.createDataFrame(docs, "doc_id long, text string")) == want


def test_runs_of_the_table(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    want = Counter(_plain_collapse(*d) for d in _rows(documents))
    assert sum(r[1] for r in want) > 0
    assert _collapse(documents) == want


def test_runs_in_odd_rows(spark, odd, none):
    assert _collapse(odd) == Counter(_plain_collapse(*d) for d in _rows(odd))
    assert _collapse(none) == Counter()
    long = [(11, "a " * 30_000), (12, "a b " * 9_000 + "a a a a a a a " + "x y z " * 5)]
    got = {r.doc_id: r for r in runs.find_runs(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[11].runs] == [(0, 30_000, 1)] and got[11].collapsed == "a"
    assert [tuple(r) for r in got[12].runs] == [(0, 18_001, 2), (18_000, 7, 1), (18_007, 15, 3)]


def test_lyndon_lengths():
    rng = random.Random(2)
    for _ in range(800):
        s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 40))]
        want = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]
        assert runs.lyndon_lengths(np.array(s)).tolist() == want
