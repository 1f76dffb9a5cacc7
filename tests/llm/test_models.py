import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import crf, toxicity
from parley.llm.registry import QUERIES
from parley.llm.words import Hasher
from plain import contamination, near_duplicates

BIG = "/root/testdata/sf0.01"


def marked(spark, folder, found, label):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return found.join(labels.select("doc_id", F.col(label).alias("mark")), "doc_id").collect()


def test_held_out_quality(spark):
    found = QUERIES["op6_quality_classifier"](spark, BIG)
    rows = marked(spark, BIG, found, "quality")
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    new = [r for r in rows if r.held_out]
    assert len(new) > 40 and np.mean([r.predicted == r.mark for r in new]) > 0.95


def test_held_out_toxicity(spark):
    rows = marked(spark, BIG, QUERIES["op9_toxicity"](spark, BIG), "toxic")
    new = [r for r in rows if r.held_out]
    assert np.mean([r.rejected == bool(r.mark) for r in new]) > 0.93
    assert sum(r.rejected and not r.mark for r in new) <= 1


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    text = np.repeat([0, 1, 2], [4, 1, 3])
    emission, transition = rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs = crf.marginals(emission, transition, crf.Chain.of(text))
    want, want_pairs = np.zeros(8), np.zeros((2, 2))
    for t in range(3):
        at = np.flatnonzero(text == t)
        total, good, seen = 0, np.zeros(len(at)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(emission[i] * k for i, k in zip(at, y)) + sum(transition[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                seen[a, b] += w
        want[at] = good / total
        want_pairs += seen / total
    assert np.allclose(p, want, atol=1e-6) and np.allclose(pairs, want_pairs, atol=1e-6)


def test_lines_and_their_neighbours():
    features, size, text = crf.line_features(pa.array(["a b\n\n  \nc.", None, "", "d d d"]), Hasher())
    assert text.tolist() == [0, 0, 3] and size.tolist() == [3, 2, 5]
    wide = crf.with_neighbours(features, text)
    n = crf.FEATURES
    assert (wide[0, 2 * n:] == features[1]).all() and (wide[0, n:2 * n] == 0).all() and (wide[2, n:] == 0).all()


def test_batches_do_not_change_scores(spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(40).collect()]
    rng = np.random.default_rng(1)
    model = crf.Model(rng.normal(size=3 * crf.FEATURES), rng.normal(size=(2, 2)), 1.0, 0.0, 0.5)
    alone = [crf.score(model, pa.array([t]), Hasher())[0] for t in texts]
    assert np.allclose(crf.score(model, pa.array(texts), Hasher()), alone, atol=1e-9)
    chain = toxicity.Chain(toxicity.listed_hashes(Hasher())[0], [toxicity.Link(np.ones(5), np.ones(4))])
    lists = toxicity.listed_hashes(Hasher())
    one = [chain.probabilities(pa.array([t]), Hasher(), lists)[0, 0] for t in texts]
    assert np.allclose(chain.probabilities(pa.array(texts), Hasher(), lists)[:, 0], one)


def test_models_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2) for i in range(12)] * 2 + [(None, 1, 1), (99, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    for found, column in ((crf.quality(odd, labels), "score"), (toxicity.predict(odd, labels), "p_toxic")):
        rows = found.collect()
        assert len(rows) == odd.count() and all(0 <= r[column] <= 1 for r in rows)
        assert all(r.held_out for r in rows if r.doc_id is None)
    assert {r.score for r in crf.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.rejected for r in toxicity.predict(odd, labels.limit(0)).collect()} == {False}
    assert crf.quality(none, labels).count() == toxicity.predict(none, labels).count() == 0
    for kept in (crf.keep_good(odd, labels.limit(0)), toxicity.keep_clean(odd, labels.limit(0))):
        assert kept.columns == odd.columns and kept.count() == odd.count()


def test_toxic_words_of_any_language_make_categories(spark):
    """Invented words of two languages; held-out recall by language."""
    rng = np.random.default_rng(3)
    prose = {"one": [f"aro{i}x" for i in "abcdefghijklmnop"], "two": [f"belu{i}z" for i in "abcdefghijklmnop"]}
    bad = {"one": ["grobnik", "mulvash", "tarkel"], "two": ["ziffolo", "perdunt", "quascan"]}
    docs, marks = [], []
    for i in range(600):
        lang = ("one", "two")[i // 4 % 2]
        toxic = i % 4 == 0
        words = list(rng.choice(prose[lang], 30)) + (list(rng.choice(bad[lang], 2)) if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words), lang))
        marks.append((i, int(toxic)))
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = toxicity.predict(documents, spark.createDataFrame(marks, "doc_id long, toxic int"))
    kinds = [c for c in found.columns if c.startswith("p_") and c != "p_toxic"]
    rows = found.join(documents, "doc_id").where("held_out").collect()
    for lang in prose:
        toxic = [r for r in rows if r.lang == lang and r.doc_id % 4 == 0]
        clean = [r for r in rows if r.lang == lang and r.doc_id % 4]
        assert np.mean([r.rejected for r in toxic]) > 0.9 and not any(r.rejected for r in clean)
        assert np.mean([max(r[k] for k in kinds) > 0.5 for r in toxic]) > 0.9


def test_a_fold_has_no_part_in_the_choice_of_its_features(spark):
    """Each toxic document shares a word with those of its fold alone; the word tells of toxic
    documents in all folds but is not chosen where its own fold is left out."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    fold = toxicity.fold_of("doc_id")
    mark = F.when(F.col("label") == 1, F.concat(F.lit("mark"), F.translate(fold.cast("string"), "0123", "abcd"))).otherwise("plain")
    sample = docs.select("doc_id", F.concat_ws(" ", mark, F.lit("common words here")).alias("text"), "label")
    chosen = toxicity.telling_words(sample, 1000)
    assert len(chosen) == 1 + toxicity.FOLDS
    for k in range(toxicity.FOLDS):
        (word,) = toxicity.listed_hashes(Hasher(), {"x": ["mark" + "abcd"[k]]})
        found = [np.isin(word, c).all() for c in chosen]
        assert found == [True] + [j != k for j in range(toxicity.FOLDS)]


def test_categories_are_put_in_order():
    a, b, c = (np.array(x) for x in ([1, 2, 3], [4, 5, 6], [7, 8]))
    assert [x.tolist() for x in toxicity.aligned([c[:1], a[:2], b], [a, b, c])] == [[1, 2], [4, 5, 6], [7]]
    assert [x.tolist() for x in toxicity.aligned([a, a, a], [b, b, b])] == [a.tolist()] * 3


def test_the_chain_agrees_with_one_fitted_plainly():
    """Dense matrices, one model after another, over the same choices."""
    rng = np.random.default_rng(4)
    n, width = 240, 12
    known = np.arange(100, 100 + width).astype("u8")
    counts = rng.integers(0, 3, (n, width)) * (rng.random((n, width)) < 0.4)
    toxic = ((counts[:, 0] + counts[:, 1] + rng.random(n)) > 1.5).astype("f8")
    fold = rng.integers(0, toxicity.FOLDS, n)
    masks = [np.ones(width, bool)] + [rng.random(width) < 0.8 for _ in range(toxicity.FOLDS)]
    choices = [toxicity.Choice(m, [known[m][:2], known[m][2:3]]) for m in masks]
    row, column = np.nonzero(counts)
    words = toxicity.Words(n, row, column, np.log1p(counts[row, column]))
    chain = toxicity.fit(words, toxic, known, fold, choices)

    def plain_fit(x, label):
        w = np.zeros(x.shape[1])
        share = label.mean()
        w[-1] = 30.0 * (2 * share - 1) if share in (0, 1) else np.log(share / (1 - share))
        penalised = np.arange(x.shape[1]) < width
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for k in range(1, toxicity.ROUNDS + 1) if share not in (0, 1) else ():
            error = (label - 1 / (1 + np.exp(-(x @ w)))) / len(label)
            g = x.T @ error - toxicity.PENALTY * w * penalised
            mean, square = mean + 0.1 * (g - mean), square + 0.01 * (g * g - square)
            w = w + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        return w

    earlier = np.zeros((n, 0))
    for number, link in enumerate(chain.links):
        out, full = np.zeros(n), None
        for k, choice in enumerate(choices):
            listed = np.stack([np.log1p(counts[:, np.isin(known, c)].sum(1)) for c in choice.categories], 1)
            odds = np.log(np.clip(earlier, 1e-4, 1 - 1e-4) / (1 - np.clip(earlier, 1e-4, 1 - 1e-4)))
            x = np.concatenate([np.log1p(counts) * choice.mask, listed, odds, np.ones((n, 1))], 1)
            target = (toxic == 1) & (listed[:, number] > 0) if number < 2 else toxic == 1
            use = (toxic != 1) | (listed > 0).any(1) if number < 2 else np.ones(n, bool)
            use &= (fold != k - 1) | (k == 0)
            w = plain_fit(x[use], target[use].astype(float))
            if k == 0:
                full = w
            else:
                out[fold == k - 1] = 1 / (1 + np.exp(-(x[fold == k - 1] @ w)))
        assert np.allclose(np.concatenate([link.words, link.dense]), full, atol=1e-6)
        earlier = np.concatenate([earlier, out[:, None]], 1)


# ------------------------------------------------------------------ pipeline

def test_pipeline_against_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    toxic = {r.doc_id for r in toxicity.predict(docs, labels).where("rejected").collect()}
    rest = docs.where(~F.col("doc_id").isin(toxic))
    bad = {r.doc_id for r in crf.quality(rest, labels).where("predicted = 0").collect()}
    left = [(r.doc_id, r.text) for r in rest.collect() if r.doc_id not in bad]
    groups = near_duplicates(left, 5)
    left = [(d, t) for d, t in left if groups[d][1] == d]
    left = [d for d, _, hit, _ in contamination(left, items) if not hit]
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in found} == set(left)
    for d in left:
        pieces = [r for r in found if r.doc_id == d]
        assert sum(r.length for r in pieces) == pieces[0].doc_tokens


def test_stages_keep_columns(spark, odd, none, folder):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).dtypes == odd.dtypes, name
        assert stage(spark, none, folder).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]


def test_lines_for_fitting_are_bounded_and_spread():
    assert crf.fitted_lines(7).tolist() == list(range(7)) and len(crf.fitted_lines(0)) == 0
    for n in (crf.FIT_LINES, crf.FIT_LINES + 1, 5000, 2_000_000):
        lines = crf.fitted_lines(n)
        assert len(lines) <= crf.FIT_LINES and lines[0] == 0 and lines[-1] == n - 1
        assert (np.diff(lines) > 0).all()
