"""Document quality from a linear-chain conditional random field over lines.

Every line with a word in it is good or bad.  What speaks for either are the line's own
features and those of the lines before and after it; neighbouring labels are tied by
transition weights.  Forward-backward passes give each line's probability of being good;
weighted by the lines' lengths they make up the document's quality, which a logistic
curve turns into the probability of label 1.

Labels are given for documents, not lines.  Lines of good documents are taken as good.  In
a bad document the lines count as bad that a line-by-line logistic model, fitted first, finds
more likely bad than good, and at least its worst line.

The model is fitted on at most ``SAMPLE`` labelled documents, and on at most ``FIT_LINES``
lines of each, evenly spaced stretches of a longer one (features only: they pass through the
driver, ``SAMPLE * FIT_LINES * FEATURES`` numbers at most); it is applied to every whole text.
Batches are scored as arrays over all their documents.

Defined cases: a text without lines (null, empty, blank) has no evidence; its quality is the
share of good lines in the sample.  Rows that repeat a document are scored each; labels
without documents are ignored; without labels, or with one kind only, the score is the
share of label 1 (0.5 without any).  Ids, languages and sources are never features.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from parley.llm.samples import held_out, labelled
from parley.llm.shared import slices
from parley.llm.words import Hasher, ascii_words, lowered, raw_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 4000
ROUNDS = 200
FEATURES = 16
FIT_LINES = 256
FIT_STRETCH = 32  # lines taken together
THRESHOLD = 0.3


def line_features(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: features, length in bytes, and number of its text."""
    data, at = raw_texts(column)
    first, last, word_text = ascii_words(data, at)
    # A line ends at a line feed or with its text.
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = data == 10
    ends[at] = True
    line_of = np.cumsum(ends[:-1]) if len(data) else np.zeros(0, "i8")
    word_line = line_of[first] if len(first) else np.zeros(0, "i8")
    new = np.ones(len(first), bool)
    new[1:] = word_line[1:] != word_line[:-1]
    begin = np.flatnonzero(new)  # first word of each line
    if not len(begin):
        return np.zeros((0, FEATURES), "f4"), np.zeros(0), np.zeros(0, "i8")
    end = np.append(begin[1:], len(first))
    start, stop, text = first[begin], last[end - 1], word_text[begin]
    n_words, size = end - begin, stop - start
    line = np.cumsum(new) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, "i8")
        np.cumsum(mask, out=sums[1:])
        return sums[stop] - sums[start]

    table = np.zeros(256, "u1")
    for code, characters in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789",
                                       b"#*$%&<>~^=+@\\_{}[]", b"|\t", b"!?", b".,;:'\"()-"), 1):
        table[list(characters)] = code
    table[128:] = 8
    kind = table[data]
    upper, lower, digit, symbol, bar, mark, plain, high = (count(kind == k) for k in range(1, 9))

    hashes = hasher.spans(lowered(data), first, last)
    again = np.zeros(len(first), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & ~new[1:]
    order = np.lexsort((hashes, line))
    unlike = np.ones(len(first), bool)
    unlike[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    n_distinct = np.bincount(line[order][unlike], minlength=len(begin))
    n_again = np.add.reduceat(again, begin) if len(begin) else np.zeros(0)
    line_hash = hasher.spans(data, start, stop)
    order = np.lexsort((np.arange(len(begin)), line_hash, text))
    copy = np.zeros(len(begin), bool)
    copy[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (text[order][1:] == text[order][:-1])

    letters = np.maximum(upper + lower + high, 1)
    tail = data[stop - 1]
    columns = [
        np.ones(len(begin)), np.sqrt(symbol / size), np.sqrt(bar / size), np.sqrt(mark / size), upper / letters,
        np.sqrt(digit / size), np.sqrt(plain / size), n_again / n_words, 1 - n_distinct / n_words, copy,
        n_words < 3, np.log1p(n_words) / 5, np.minimum(size / n_words, 30) / 10, np.isin(tail, list(b".!?:")),
        (tail != ord(".")) & (n_words > 3), symbol + bar + mark > n_words / 5,
    ]
    return np.stack([np.asarray(c, "f4") for c in columns], 1), size.astype("f8"), text


def with_neighbours(features: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and the line after in its text."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    same = text[1:] == text[:-1]
    before[1:][same] = features[:-1][same]
    after[:-1][same] = features[1:][same]
    return np.concatenate([features, before, after], 1)


@dataclass
class Chain:
    """Padded view of the lines of many texts: longest text first, ``alive[t]`` of them have
    a line number t."""

    rows: np.ndarray  # line numbers, text by text
    alive: np.ndarray

    @staticmethod
    def of(text: np.ndarray) -> Chain:
        _, first, n = np.unique(text, return_index=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        first, n = first[order], n[order]
        alive = np.searchsorted(-n, -np.arange(n[0]) - 1, "right") if len(n) else np.zeros(0, "i8")
        return Chain(first, alive)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def marginals(emission: np.ndarray, transition: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Per line the probability of good; and the expected number of each transition.

    ``emission`` is the log-odds of good by the features, ``transition`` 2 x 2 weights.
    """
    local = np.stack([_sigmoid(-emission), _sigmoid(emission)], 1) + 1e-12
    step = np.exp(transition - transition.max())
    forward, backward = np.zeros_like(local), np.ones_like(local)
    pairs = np.zeros((2, 2))
    for t, n in enumerate(chain.alive):
        at = chain.rows[:n] + t
        now = local[at] if t == 0 else (forward[at - 1] @ step) * local[at]
        forward[at] = now / now.sum(1, keepdims=True)
    for t in range(len(chain.alive) - 2, -1, -1):
        at = chain.rows[:chain.alive[t + 1]] + t
        ahead = local[at + 1] * backward[at + 1]
        back = ahead @ step.T
        joint = forward[at][:, :, None] * step[None] * ahead[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        backward[at] = back / back.sum(1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(1), pairs


def _climb(gradient, start: np.ndarray, rounds: int = ROUNDS, rate: float = 0.1) -> np.ndarray:
    """Gradient ascent with a step size for each weight (Adam)."""
    w, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, rounds + 1):
        g = gradient(w)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w + rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return w


@dataclass
class Model:
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    level: float
    share_good: float  # of lines
    constant: float | None = None


def document_quality(good: np.ndarray, size: np.ndarray, text: np.ndarray, n_texts: int, otherwise: float) -> np.ndarray:
    """Probabilities weighted by length; ``otherwise`` for texts without lines."""
    weight = np.bincount(text, size, n_texts)
    return np.where(weight > 0, np.bincount(text, size * good, n_texts) / np.maximum(weight, 1), otherwise)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(features: np.ndarray, size: np.ndarray, text: np.ndarray, label: np.ndarray, penalty: float = 1e-3) -> Model:
    """``label`` is per text, the others per line, texts in order."""
    kinds = np.unique(label)
    x = with_neighbours(features, text).astype("f8")
    blank = Model(np.zeros(3 * FEATURES), np.zeros((2, 2)), 1.0, 0.0, 0.5)
    if len(kinds) < 2 or not len(text):
        blank.constant = float(np.mean(label)) if len(label) else 0.5
        return blank
    n, y = len(text), label[text].astype("f8")
    # Kinds count alike, or the many good lines would drown the bad ones.
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    alone = _climb(lambda w: x.T @ (weight * (y - _sigmoid(x @ w))) - penalty * w, np.zeros(x.shape[1]))
    odds = x @ alone
    worst = np.full(len(label), np.inf)
    np.minimum.at(worst, text, odds)
    good = (label[text] == 1) | ((odds > 0) & (odds > worst[text]))

    chain, y = Chain.of(text), good.astype("f8")
    same = text[1:] == text[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[:-1][same].astype(int), good[1:][same].astype(int)), 1)

    def gradient(w: np.ndarray) -> np.ndarray:
        p, pairs = marginals(x @ w[:-4], w[-4:].reshape(2, 2), chain)
        return np.concatenate([x.T @ (y - p) / n, (seen - pairs).ravel() / n]) - penalty * w

    w = _climb(gradient, np.concatenate([alone, np.zeros(4)]))
    model = Model(w[:-4], w[-4:].reshape(2, 2), 1.0, 0.0, float(good.mean()))
    p, _ = marginals(x @ model.weights, model.transition, chain)
    quality = _log_odds(document_quality(p, size, text, len(label), model.share_good))
    z = np.stack([quality, np.ones(len(label))], 1)
    model.slope, model.level = _climb(
        lambda v: z.T @ (label - _sigmoid(z @ v)) / len(label) - np.array([1e-4, 0]) * v, np.array([1.0, 0.0]))
    return model


def score(model: Model, column: pa.Array, hasher: Hasher) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(column), model.constant)
    features, size, text = line_features(column, hasher)
    p = np.zeros(0)
    if len(text):
        p, _ = marginals(with_neighbours(features, text) @ model.weights, model.transition, Chain.of(text))
    quality = _log_odds(document_quality(p, size, text, len(column), model.share_good))
    return _sigmoid(model.slope * quality + model.level)


def fitted_lines(n: int) -> np.ndarray:
    """The lines of a document of ``n`` that the model is fitted on: all, or evenly spaced
    stretches, so that most lines have their neighbours."""
    if n <= FIT_LINES:
        return np.arange(n)
    starts = np.linspace(0, n - FIT_STRETCH, FIT_LINES // FIT_STRETCH).astype("i8")
    return np.unique((starts[:, None] + np.arange(FIT_STRETCH)).ravel())


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, 256):
            features, size, text = line_features(batch.column(1), hasher)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            chosen = np.concatenate([np.zeros(0, "i8"), *(a + fitted_lines(b - a) for a, b in zip(cut, cut[1:], strict=False))])
            features, size, text = features[chosen], size[chosen], text[chosen]
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            yield pa.record_batch(
                [batch.column(0), batch.column(2),
                 pa.array([features[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                 pa.array([size[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())],
                ["doc_id", "label", "features", "size"])

    rows = labelled(documents, labels, label, sample).mapInArrow(
        lines, "doc_id long, label int, features binary, size binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    features = np.frombuffer(b"".join(r.features for r in rows), "f4").reshape(-1, FEATURES)
    size = np.frombuffer(b"".join(r["size"] for r in rows), "f8")
    text = np.repeat(np.arange(len(rows)), [len(r["size"]) // 8 for r in rows])
    return fit(features, size, text, np.array([r.label for r in rows], "f8"))


def quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``documents``: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    model = train(documents, labels, sample=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, 256):
            yield pa.record_batch([batch.column(0), pa.array(score(model, batch.column(1), hasher))], ["doc_id", "score"])

    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``documents`` with all their columns, without those that score under the threshold."""
    model = train(documents, labels, sample=sample)
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, 256):
            yield batch.filter(pa.array(score(model, batch.column(text), hasher) >= THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
