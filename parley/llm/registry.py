"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from parley.llm import (
    codes, crf, decontaminate, importance, neardup, packing, rollup, rules, runs, shards, suffixes, toxicity, urls,
)
from parley.llm.shared import holding, table
from parley.llm.tokens import vocabulary
from parley.session import run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Batch 1 inserts all documents.  Batch 2 deletes those labelled bad and counts those
    labelled toxic anew with the next tokenizer version; it is sent twice."""
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    store = rollup.Rollup(spark, run_folder(spark, "token-rollup"))
    counted = rollup.count_tokens(documents, vocabulary("byte_bpe_50k.json"))
    seq = F.lit(0).cast("long").alias("seq")
    store.commit(1, counted.select(
        F.lit("insert").alias("op"), seq, "doc_id", "source", "lang", F.lit("byte_bpe_50k").alias("version"), "n_tokens"))
    marked = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    gone = marked.where("quality = 0").select("doc_id")
    again = holding(documents, marked.where("quality = 1 AND toxic = 1"), "doc_id")
    recounted = rollup.count_tokens(again, vocabulary("word_bpe_49k.json"))
    null = F.lit(None).cast("string")
    changes = recounted.select(
        F.lit("revise").alias("op"), seq, "doc_id", "source", "lang", F.lit("word_bpe_49k").alias("version"), "n_tokens",
    ).unionByName(gone.select(
        F.lit("delete").alias("op"), seq, "doc_id", null.alias("source"), null.alias("lang"), null.alias("version"),
        F.lit(None).cast("long").alias("n_tokens")))
    for _ in range(2):
        store.commit(2, changes)
    return store.totals()


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    return packing.digests(pieces)


@query
def op10_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    files = run_folder(spark, "token-codes")
    manifest = codes.write_codes(table(spark, folder, "documents"), files, vocabulary("word_bpe_49k.json"), end_id=2)
    return codes.read_codes(spark, files, manifest)


@query
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=4, percent=80)


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op3_decontamination"] = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents),
item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS passage
    FROM item, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS u(i) WHERE len(words) > 0),
size AS (SELECT DISTINCT n FROM win),
place AS (
    SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS passage
    FROM doc, size, unnest(range(1, len(words) - n + 2)) AS u(i)),
hit AS (SELECT doc_id, item_id, i, n FROM place JOIN win USING (n, passage)),
inside AS (SELECT DISTINCT doc_id, i + k AS at FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(n)) AS u(k)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM inside GROUP BY doc_id),
owners AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(table(spark, folder, "documents")).drop("rules_run")


ORACLES["op4_quality_rules"] = r"""
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
lines AS (
    SELECT doc_id, count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]'))
                 - count(DISTINCT line) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_dup_lines, count(*) AS n_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc) GROUP BY doc_id),
place AS (
    SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS passage, words
    FROM doc, unnest(range(1, len(words) - 3)) AS u(i)),
twice AS (SELECT doc_id, i FROM place QUALIFY count(*) OVER (PARTITION BY doc_id, passage) > 1),
repeats AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest(range(5)) AS u(k) GROUP BY doc_id),
tops AS (
    SELECT doc_id, max(n) AS top FROM (
        SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM doc) GROUP BY doc_id, w) GROUP BY doc_id),
base AS (
    SELECT doc_id, text, len(words) AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, n_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(top, 0) AS top,
           length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks,
           length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper,
           length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters
    FROM doc JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN tops USING (doc_id)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND 10 * n_dup_lines <= 3 * n_lines
       AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 5 * n_marks <= n_words
       AND 10 * top <= 3 * n_words AND 2 * n_upper <= n_letters AS kept
FROM failed
"""


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


@query
def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, folder, "pages"), listed)


ORACLES["op8_url_filters"] = r"""
WITH rest AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest),
rule(host, path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
    SELECT page_id, r.host || r.path AS rule, verdict
    FROM split s JOIN rule r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fit USING (page_id)
"""


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return crf.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.predict(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    scored = importance.importance(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op11_importance_resampling"] = r"""
WITH RECURSIVE shifted(i, k, c) AS (
    SELECT i, 0, i FROM range(256) AS t(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM shifted WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM shifted WHERE k = 8),
words AS (
    SELECT 'd' AS side, doc_id, row_number() OVER () AS id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
    UNION ALL
    SELECT 'b', NULL, row_number() OVER (), regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
feature AS (
    SELECT side, id, array_to_string(words[i:i + k - 1], ' ') AS f
    FROM words, range(1, 4) AS ks(k), unnest(range(1, len(words) - k + 2)) AS u(i)),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feature)),
bucket AS (
    SELECT f, xor(list_reduce(
        list_transform(range(len(h) // 2), lambda j: ('0x' || h[2 * j + 1:2 * j + 2])::BIGINT),
        lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b
    FROM bytes, crc),
placed AS (SELECT side, id, b FROM feature JOIN bucket USING (f)),
counts AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY b),
total AS (SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed),
gain AS (
    SELECT b, floor(1000 * ln((counts.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE
                              / ((counts.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS g
    FROM counts, total),
weight AS (SELECT id, count(*) AS n, sum(g)::BIGINT AS w FROM placed JOIN gain USING (b) WHERE side = 'd' GROUP BY id),
scored AS (
    SELECT doc_id, len(words) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight,
           coalesce(w, 0)::BIGINT + floor(-1000 * ln(-ln(
               (('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM words LEFT JOIN weight USING (id) WHERE side = 'd'),
placed_score AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r,
           count(*) FILTER (n_words >= 20) OVER () AS n
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM placed_score
"""


@query
def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(table(spark, folder, "documents")))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digests(runs.find_runs(table(spark, folder, "documents"), plant=True))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
