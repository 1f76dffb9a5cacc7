"""Packing, token codes and token counts against the tokenizers library called on whole texts."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import codes, packing, rollup
from parley.llm.registry import QUERIES
from parley.llm.shared import holding
from parley.llm.tokens import Encoder, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def whole(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_give_the_ids_of_the_whole_text(path):
    rng, plain, encoder = random.Random(7), whole(path), Encoder(path)
    parts = ["the", "Thé", " ", "  ", "\n", "\t", "\r\n", " ", " ", "don't", "I'LL", "x's", "12", "3.5", "!!", "...", ",",
             "́", "ß", "İ", "你好", "\U0001F600", "<|endoftext|>", "<|", "café", "\x1c", "\x85", "　", "​",
             "a_b", "re-do", "ing", "SHOUT", "#", "$x", "٠"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert encoder.encode(text) == packed(plain(text)), repr(text)
    assert encoder.encode(None) == encoder.encode("") == b""


def check_pieces(rows, ids_of, window=1024):
    """Every id lies in one piece, sequences have no gaps, only the last is short."""
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_document[r.doc_id].append(r)
    for sequence, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == window or sequence == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc_id, texts in ids_of.items():
        pieces = by_document[doc_id]
        found = sorted((r.start, r.length, r.ids_crc32) for r in pieces)
        assert sum(p[1] for p in found) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for start, length, crc in found:
                assert start == at and crc == zlib.crc32(packed(texts[0][at:at + length]))
                at += length
            assert all(r.doc_tokens == len(texts[0]) for r in pieces)


def ids_by_document(df, plain, end):
    found = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        found[r.doc_id].append(plain(r.text) + [end])
    return found


def test_packing_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check_pieces(QUERIES["op2_packing"](spark, folder).collect(), ids_by_document(docs, whole(BYTE), 0))


def test_packing_odd_rows(odd, none):
    pieces = packing.pack(odd.repartition(3), BYTE, window=64)
    check_pieces(packing.digests(pieces).collect(), ids_by_document(odd, whole(BYTE), 0), 64)
    full = packing.sequences(pieces, 64, pad_id=5).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 256 for r in full) and all(r.n_tokens == 64 for r in full[:-1])
    assert full[-1].ids[4 * full[-1].n_tokens:] == packed([5] * (64 - full[-1].n_tokens))
    assert packing.pack(none, BYTE).count() == 0


def test_code_round_trip_and_access():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.where(rng.random(n) < 0.5, rng.integers(0, 256, n), rng.integers(0, 1 << 20, n)).astype("<u4")
        image = codes.file_image([1, None], [ids.tobytes(), b""], 2, 3)
        file = codes.TokenFile(lambda at, k, image=image: image[at:at + k])
        assert (file.all_ids() == ids).all() and [file[i] for i in range(n)] == ids.tolist()
        assert (file.part, file.k) == (2, 3)
        with pytest.raises(IndexError):
            file[n]


def check_codes(rows, df, plain):
    at, found = 0, sorted(rows, key=lambda r: r.start)
    texts = ids_by_document(df, plain, 2)
    for r in found:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(packed(x))) for x in texts[r.doc_id]]
    assert len(found) == df.count()
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in found), key=lambda x: (x is not None, x))


def test_codes_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check_codes(QUERIES["op10_token_codes"](spark, folder).collect(), docs, whole(WORD))


def test_codes_odd_rows_and_access(spark, odd, none, tmp_path):
    manifest = codes.write_codes(odd, str(tmp_path), WORD, 2, file_tokens=1000)
    check_codes(codes.read_codes(spark, str(tmp_path), manifest).collect(), odd, whole(WORD))
    every = []
    docs = codes.read_codes(spark, str(tmp_path), manifest).orderBy("start").collect()
    texts = ids_by_document(odd, whole(WORD), 2)
    for r in docs:
        every += next(x for x in texts[r.doc_id] if zlib.crc32(packed(x)) == r.ids_crc32)
    asked = spark.range(0, len(every) + 10, 7).withColumnRenamed("id", "position")
    found = {r.position: r.id for r in codes.tokens_at(asked, str(tmp_path), manifest).collect()}
    assert found == {i: every[i] for i in range(0, len(every), 7)}
    empty = codes.write_codes(none, str(tmp_path / "none"), WORD, 2)
    assert codes.read_codes(spark, str(tmp_path / "none"), empty).count() == 0


def totals(rows):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rows}


def test_rollup_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    marks = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        marks[r.doc_id] = (r.quality, r.toxic)
    want = defaultdict(lambda: [0, 0])
    byte, word = whole(BYTE), whole(WORD)
    for d in docs:
        quality, toxic = marks.get(d.doc_id, (1, 0))
        if quality == 0:
            continue
        version, n = ("word_bpe_49k", len(word(d.text))) if toxic else ("byte_bpe_50k", len(byte(d.text)))
        want[d.source, d.lang, version][0] += 1
        want[d.source, d.lang, version][1] += n
    assert totals(QUERIES["op1_token_counts"](spark, folder).collect()) == {k: tuple(v) for k, v in want.items()}


def test_rollup_batches(spark, tmp_path, odd):
    changes = "op string, seq long, doc_id long, source string, lang string, version string, n_tokens long"

    def batch(*rows):
        return spark.createDataFrame(list(rows), changes)

    store = rollup.Rollup(spark, str(tmp_path / "a"))
    assert store.totals().count() == 0
    first = batch(("insert", 0, 1, "s", "en", "v1", 10), ("insert", 0, 2, "s", "en", "v1", 5),
                  ("insert", 0, 3, None, None, "v1", 7), ("insert", 0, None, "s", "en", "v1", 99))
    assert store.commit(1, first) and not store.commit(1, first)
    assert rollup.refused(first).count() == 1
    assert totals(store.totals().collect()) == {("s", "en", "v1"): (2, 15), (None, None, "v1"): (1, 7)}
    assert store.commit(2, batch(
        ("delete", 0, 1, None, None, None, None), ("revise", 0, 2, "s", "en", "v2", 6), ("delete", 0, 77, None, None, None, None),
        ("delete", 0, 3, None, None, None, None), ("insert", 1, 3, "t", "de", "v2", None)))
    want = {("s", "en", "v2"): (1, 6), ("t", "de", "v2"): (1, 0)}
    assert totals(store.totals().collect()) == want
    # A batch that broke off before its commit is no part of the totals, and is done again.
    store._write(spark.createDataFrame([("s", "en", "v2", 100, 100)], rollup._DELTA), "deltas", 3)
    assert totals(store.totals().collect()) == want
    assert store.commit(3, batch()) and totals(store.totals().collect()) == want
    with pytest.raises(ValueError):
        store.commit(0, batch())
    folded = rollup.Rollup(spark, str(tmp_path / "b"))
    store.compact(folded)
    assert totals(folded.totals().collect()) == want
    assert folded.commit(4, batch(("delete", 0, 2, None, None, None, None)))
    assert totals(folded.totals().collect()) == {("t", "de", "v2"): (1, 0)}
    counted = {(r.doc_id, r.n_tokens) for r in rollup.count_tokens(odd.where("length(text) < 50 OR text IS NULL"), BYTE).collect()}
    assert (3, 0) in counted and (4, 0) in counted
    assert rollup.count_tokens(odd.limit(0), BYTE).select(F.sum("n_tokens")).first()[0] is None


def test_holding_keeps_the_rows_with_a_key_whatever_their_number(spark, odd):
    """With the keys broadcast, and beyond that with a sieve and a shuffle."""
    keys = spark.createDataFrame([(i,) for i in (2, 2, 6, 9, 77, None)], "doc_id long")
    for most in (100, 0):
        held = holding(odd, keys, "doc_id", most)
        assert held.columns == odd.columns
        assert sorted(r.doc_id for r in held.collect()) == [2, 2, 6, 9, 9]
        assert holding(odd, keys.limit(0), "doc_id", most).count() == 0
    every = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    some = every.where("doc_id % 7 = 3")
    assert holding(every, some, "doc_id", 5).count() == some.count()


def test_small_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    from parley.llm import shared

    def broadcast(df, *most):
        return "BroadcastExchange" in spark.range(5).join(shared.small(df, *most), "id")._jdf.queryExecution().executedPlan().toString()

    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        narrow = spark.range(50).withColumn("x", F.lit(1.5))
        wide = spark.range(50).withColumn("terms", F.array(F.lit("word" * 100)))
        assert broadcast(narrow) and broadcast(wide) and not broadcast(narrow, 49) and not broadcast(wide, 49)
        monkeypatch.setattr(shared, "BROADCAST_BYTES", 10_000)
        assert broadcast(narrow) and not broadcast(wide)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
