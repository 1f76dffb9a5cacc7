"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another.  The model of a category sees the words of
a text, the number of features from each category's list, and the probabilities of all
categories before it.  For fitting, those probabilities are out-of-fold: a document's come
from models that were fitted without it, so later models see them as noisy as
they will be in use.  The last link of the chain is the label ``toxic`` itself; a document is
rejected where its probability reaches ``THRESHOLD``.

The earlier categories have no labels of their own; they are found in the documents fitted
on.  Features that are ``LIFT`` times as frequent in toxic documents as in others, whatever
the language, are put into ``CATEGORIES`` groups by the toxic documents they share (spherical
k-means).  So a category is a kind of evidence, numbered, without a meaning given to it.  Lists
of words can be passed instead.  A document counts as an example where it is labelled toxic and
has a feature of the category's list; a toxic one without a feature of any list tells nothing
about categories, and only the last link learns from it.

The chain is fitted on at most ``SAMPLE`` labelled documents, on at most ``WORDS`` features that
tell the label apart in the documents fitted on (chosen anew for each fold); only the counts
of these pass through the driver.  It is applied to every whole text, batches as arrays.

Words are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  A feature is a
whole word or a word's first 4 to 8 bytes (so that one stem's inflections and compounds
count together), known by hash.

Defined cases: null and empty texts, and texts without known words, have the probabilities
of no evidence.  Rows that repeat a document are judged each; labels without documents are
ignored; a category without examples, or without counterexamples, has the share of its
examples as probability (0 without any label), and nothing is rejected for lack of labels.
Ids, languages and sources are never features.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.samples import held_out, labelled
from parley.llm.shared import slices, written
from parley.llm.words import Hasher, distinct, raw_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 6000
WORDS = 3000
STARTS = (4, 5, 6, 7, 8)
FOLDS = 3
THRESHOLD = 0.5
ROUNDS = 120
PENALTY = 1e-4

CATEGORIES = 3  # found in the sample, if no lists are passed
LIFT = 10
LEAST = 3  # toxic documents that a category's feature is in


def text_words(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and word starts, the number of the text each is in, and which of
    them are whole words."""
    data, at = raw_texts(column)
    folded = data | np.uint8(32)  # lower case, for letters
    letter = (data >= 128) | ((folded >= 97) & (folded <= 122))
    inside = np.append(letter, False)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    stops = np.flatnonzero(before & (~inside | edge))
    lower = np.where(data < 128, folded, data)
    text = np.searchsorted(at, starts, "right") - 1
    first, last, texts = [starts], [stops], [text]
    for k in STARTS:
        long = stops - starts >= k
        first.append(starts[long])
        last.append(starts[long] + k)
        texts.append(text[long])
    kind = np.repeat(np.arange(len(first), dtype="u8"), [len(x) for x in first])
    hashes = hasher.spans(lower, np.concatenate(first), np.concatenate(last)) ^ (kind * np.uint64(0x9E3779B97F4A7C15))
    return hashes, np.concatenate(texts), kind == 0


def listed_hashes(hasher: Hasher, lists: dict[str, list[str]] | None = None) -> list[np.ndarray]:
    """The hashes of each list's words; without lists, of ``CATEGORIES`` empty ones."""
    found = []
    for words in lists.values() if lists else [[]] * CATEGORIES:
        hashes, _, whole = text_words(pa.array([" ".join(words)]), hasher)
        found.append(np.unique(hashes[whole]))
    return found


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _log_odds(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Words:
    """Sparse counts: word number ``at[1]`` occurs ``value`` (log of 1 + count) in text ``at[0]``."""

    n: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def back(self, error: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.value * error[self.row], width)

    def part(self, keep: np.ndarray) -> Words:
        number = np.cumsum(keep) - 1
        inside = keep[self.row]
        return Words(int(keep.sum()), number[self.row[inside]], self.column[inside], self.value[inside])


@dataclass
class Link:
    """One category's model: weights of words and of dense inputs (the last is constant)."""

    words: np.ndarray
    dense: np.ndarray

    def probability(self, words: Words, dense: np.ndarray) -> np.ndarray:
        return _sigmoid(words.times(self.words) + dense @ self.dense)


def fit_link(words: Words, dense: np.ndarray, label: np.ndarray, width: int) -> Link:
    link = Link(np.zeros(width), np.zeros(dense.shape[1]))
    share = label.mean() if len(label) else 0.0
    if share in (0.0, 1.0):
        link.dense[-1] = 30.0 * (2 * share - 1)
        return link
    link.dense[-1] = _log_odds(np.array(share))
    state = [np.zeros(width), np.zeros(width), np.zeros(len(link.dense)), np.zeros(len(link.dense))]
    for k in range(1, ROUNDS + 1):
        error = (label - link.probability(words, dense)) / len(label)
        steps = (words.back(error, width) - PENALTY * link.words, dense.T @ error)
        for j, (weights, g) in enumerate(((link.words, steps[0]), (link.dense, steps[1]))):
            mean, square = state[2 * j], state[2 * j + 1]
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            weights += 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return link


@dataclass
class Chain:
    known: np.ndarray  # hashes of the words with weights, in order
    links: list[Link]

    def probabilities(self, column: pa.Array, hasher: Hasher, lists: list[np.ndarray]) -> np.ndarray:
        """Per text the probability of each category, the label last."""
        words, dense = sparse_and_dense(column, hasher, self.known, lists)
        found = np.zeros((len(column), 0))
        for link in self.links:
            p = link.probability(words, inputs(dense, found))
            found = np.concatenate([found, p[:, None]], 1)
        return found


def counted(hashes: np.ndarray, text: np.ndarray, n: int, known: np.ndarray) -> Words:
    if not len(known) or not len(hashes):
        none = np.zeros(0, "i8")
        return Words(n, none, none, np.zeros(0))
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    cell, count = np.unique(text[hit] * len(known) + at[hit], return_counts=True)
    return Words(n, cell // len(known), cell % len(known), np.log1p(count))


def listed_counts(hashes: np.ndarray, text: np.ndarray, n: int, lists: list[np.ndarray]) -> np.ndarray:
    """Per text and list, the log of 1 and the number of its features."""
    columns = []
    for known in lists:
        hit = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)
        columns.append(np.log1p(np.bincount(text[hit], minlength=n)))
    return np.stack(columns, 1)


def listed_of(words: Words, known: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """``listed_counts`` from counts, where ``known`` has all features of the lists."""
    count = np.rint(np.expm1(words.value))
    return np.stack([np.log1p(np.bincount(words.row, count * np.isin(known, x)[words.column], words.n)) for x in lists], 1)


def found_categories(words: Words, toxic: np.ndarray, known: np.ndarray, n: int = CATEGORIES) -> list[np.ndarray]:
    """The features that are telling of toxic documents, in ``n`` groups by the documents
    they share; some are empty where there are too few features."""
    positive = np.bincount(words.column, toxic[words.row], len(known))
    other = np.bincount(words.column, minlength=len(known)) - positive
    lift = ((positive + 0.5) / (toxic.sum() + 1)) / ((other + 0.5) / (len(toxic) - toxic.sum() + 1))
    telling = np.flatnonzero((positive >= LEAST) & (lift >= LIFT))
    if len(telling) <= n:
        return [known[telling[k:k + 1]] for k in range(n)]
    place = np.full(len(known), -1)
    place[telling] = np.arange(len(telling))
    document = np.cumsum(toxic == 1) - 1
    there = (place[words.column] >= 0) & (toxic[words.row] == 1)
    x = np.zeros((len(telling), int(toxic.sum())), "f4")
    x[place[words.column[there]], document[words.row[there]]] = 1
    x /= np.sqrt(x.sum(1, keepdims=True))
    weight = positive[telling]
    # Frequent features unlike the earlier ones start the groups.
    first = [int(np.argmax(weight))]
    while len(first) < n:
        first.append(int(np.argmax(weight * (1 - (x @ x[first].T).max(1)))))
    centres = x[first]
    for _ in range(20):
        group = np.argmax(x @ centres.T, 1)
        centres = np.stack([x[group == k].sum(0) if (group == k).any() else centres[k] for k in range(n)])
        centres /= np.sqrt((centres * centres).sum(1, keepdims=True))
    return [np.sort(known[telling[group == k]]) for k in range(n)]


def inputs(listed: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.concatenate([listed, _log_odds(earlier), np.ones((len(listed), 1))], 1)


def sparse_and_dense(column: pa.Array, hasher: Hasher, known: np.ndarray, lists: list[np.ndarray]) -> tuple[Words, np.ndarray]:
    hashes, text, _ = text_words(column, hasher)
    return counted(hashes, text, len(column), known), listed_counts(hashes, text, len(column), lists)


def aligned(categories: list[np.ndarray], to: list[np.ndarray]) -> list[np.ndarray]:
    """The categories in the order in which they share most features with those of ``to``."""
    left, order = list(range(len(categories))), [0] * len(to)
    shared = sorted(((len(np.intersect1d(categories[i], x)), -j, -i) for j, x in enumerate(to) for i in left), reverse=True)
    open_ = set(range(len(to)))
    for _, j, i in shared:
        if -j in open_ and -i in left:
            order[-j] = -i
            open_.remove(-j)
            left.remove(-i)
    return [categories[i] for i in order]


@dataclass
class Choice:
    """What a model may use: features, as a mask of the known ones, and categories."""

    mask: np.ndarray
    categories: list[np.ndarray]

    def of(self, words: Words) -> Words:
        own = self.mask[words.column]
        return Words(words.n, words.row[own], words.column[own], words.value[own])


def fit(words: Words, toxic: np.ndarray, known: np.ndarray, fold: np.ndarray, choices: list[Choice]) -> Chain:
    """``toxic`` is the label per text; ``choices`` has the choice made on all texts, then for each
    fold the one made on the others."""
    n, many = len(toxic), len(choices[0].categories)
    own_words = [c.of(words) for c in choices]
    listed = [listed_of(words, known, c.categories) for c in choices]
    earlier, links = np.zeros((n, 0)), []
    for number in range(many + 1):
        models = []
        for k, counts in enumerate(listed):
            target = (toxic == 1) & (counts[:, number] > 0) if number < many else toxic == 1
            # A toxic text without a feature of any list is no counterexample of a category.
            use = (toxic != 1) | (counts > 0).any(1) if number < many else np.ones(n, bool)
            use &= (fold != k - 1) | (k == 0)
            dense = inputs(counts, earlier)
            models.append((fit_link(own_words[k].part(use), dense[use], target[use].astype("f8"), len(known)), dense))
        links.append(models[0][0])
        out = np.zeros(n)
        for k, (link, dense) in enumerate(models[1:]):
            own = fold == k
            out[own] = link.probability(own_words[k + 1].part(own), dense[own])
        earlier = np.concatenate([earlier, out[:, None]], 1)
    return Chain(known, links)


def fold_of(doc_id) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def telling_words(sample: DataFrame, most: int) -> list[np.ndarray]:
    """The ``most`` features whose presence differs most between the labels of ``sample``
    (chi-square), in order; one in fewer than three documents tells nothing.  First those of
    all documents, then for each fold those of the others."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, 64):
            hashes, text, _ = text_words(batch.column(1), hasher)
            hashes, text = distinct(hashes, text)
            label, fold = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in (2, 3))
            word, number = np.unique(hashes, return_inverse=True)
            columns = [pa.array(word.view("i8"))]
            for k in range(FOLDS):
                own = fold == k
                columns += [pa.array(np.bincount(number[own], minlength=len(word))),
                            pa.array(np.bincount(number[own], label[own], len(word)).astype("i8"))]
            yield pa.record_batch(columns, ["word", *names])

    names = [f"{c}{k}" for k in range(FOLDS) for c in ("n", "positive")]
    told = sample.select("doc_id", "text", "label", fold_of("doc_id").alias("fold"))
    found = told.mapInArrow(present, "word long, " + ", ".join(f"{c} long" for c in names)).groupBy("word").agg(
        *(F.sum(c).alias(c) for c in names)).where(" + ".join(f"n{k}" for k in range(FOLDS)) + " >= 3")
    found = written(found, "toxicity-words")
    labels = told.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("positive")).collect()
    best = []
    for left_out in (None, *range(FOLDS)):
        rows = [r for r in labels if r.fold != left_out]
        share = sum(r.positive for r in rows) / max(1, sum(r.n for r in rows))
        if not share:
            best.append(np.zeros(0, "u8"))
            continue
        n, positive = (sum((F.col(f"{c}{k}") for k in range(FOLDS) if k != left_out), F.lit(0)) for c in ("n", "positive"))
        expected = n * share
        score = (positive - expected) * (positive - expected) / expected
        top = found.where((n >= 3) & (score > 0)).orderBy(score.desc(), "word").limit(most).select("word").collect()
        best.append(np.sort(np.array([r.word for r in top], "i8").view("u8")))
    return best


def train(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, lists: dict[str, list[str]] | None = None,
) -> tuple[Chain, list[np.ndarray]]:
    """The chain, and the hashes of each category's features."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    drawn = written(labelled(documents, labels, "toxic", sample), "toxicity-sample").repartition(cores)
    telling = telling_words(drawn, WORDS)
    given = listed_hashes(Hasher(), lists) if lists else []
    known = np.unique(np.concatenate([*telling, *given]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, 64):
            hashes, text, _ = text_words(batch.column(1), hasher)
            words = counted(hashes, text, batch.num_rows, known)
            cut = np.searchsorted(words.row, np.arange(batch.num_rows + 1))
            spans = list(zip(cut, cut[1:], strict=False))
            yield pa.record_batch(
                [batch.column(0), batch.column(2), batch.column(3),
                 pa.array([words.column[a:b].astype("i4").tobytes() for a, b in spans], pa.binary()),
                 pa.array([words.value[a:b].astype("f4").tobytes() for a, b in spans], pa.binary())],
                ["doc_id", "label", "fold", "columns", "counts"])

    told = drawn.select("doc_id", "text", "label", fold_of("doc_id").alias("fold"))
    rows = told.mapInArrow(count, "doc_id long, label int, fold int, columns binary, counts binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    column = np.frombuffer(b"".join(r["columns"] for r in rows), "i4").astype("i8")
    row = np.repeat(np.arange(len(rows)), [len(r["columns"]) // 4 for r in rows])
    value = np.frombuffer(b"".join(r["counts"] for r in rows), "f4").astype("f8")
    words, toxic = Words(len(rows), row, column, value), np.array([r.label for r in rows], "f8")
    fold = np.array([r.fold for r in rows], "i8")
    choices = []
    for k, chosen in enumerate(telling):
        mask = np.isin(known, np.concatenate([chosen, *given]))
        rest = (fold != k - 1) | (k == 0)
        choice = Choice(mask, given)
        if not lists:
            choice.categories = found_categories(choice.of(words).part(rest), toxic[rest], known)
            if k:
                choice.categories = aligned(choice.categories, choices[0].categories)
        choices.append(choice)
    return fit(words, toxic, known, fold, choices), choices[0].categories


def predict(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, lists: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, a probability per category (``p_category_1`` and so
    on, or by the names of ``lists``), ``p_toxic`` and ``rejected``."""
    chain, hashes = train(documents, labels, sample, lists)
    names = [f"p_{c}" for c in lists or [f"category_{k + 1}" for k in range(CATEGORIES)]] + ["p_toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, 256):
            p = chain.probabilities(batch.column(1), hasher, hashes)
            yield pa.record_batch([batch.column(0), *map(pa.array, p.T.copy())], ["doc_id", *names])

    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), *names, (F.col("p_toxic") >= THRESHOLD).alias("rejected"))


def keep_clean(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, lists: dict[str, list[str]] | None = None,
) -> DataFrame:
    """``documents`` with all their columns, without those rejected."""
    chain, hashes = train(documents, labels, sample, lists)
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, 256):
            p = chain.probabilities(batch.column(text), hasher, hashes)[:, -1]
            yield batch.filter(pa.array(p < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
