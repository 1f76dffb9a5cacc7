"""Quality rules as a short-circuit cascade.

A rule is a test that a good document passes, computed from some features of its text.  On
a sample of what the base rules let pass, every rule is applied to every document: that tells
what it rejects and what it costs, the steps of its features over what they pass over.  The
rule that rejects most per cost comes first; the next one is the best on what the first
leaves of the sample, and so on, so a rule that only rejects what others reject comes late.
Each runs only on the documents that all earlier ones let pass, and a feature is only
computed for documents that reach a rule that needs it.  The order changes the work, never
the verdict: a document is kept when no rule rejects it.

Base features are those every document is told with; the base rules on them come first.  As
they are there anyway, a rule is not charged for them.

Cost is counted, not timed: characters or words a feature passes over times the steps it takes
on each, which are constants.
So equal inputs give equal orders wherever they run.

Defined cases: words are runs of characters other than ASCII white space.  A null text is a
text without words; it fails the base rule on length.  Rows that repeat a document are
judged each; null ids and other columns play no part; an empty table or an empty sample
leaves the rules in their given order.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from parley.llm.shared import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = "#*$%&|<>"
REPEAT = 5  # words of a window that may repeat
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
SAMPLE = 2000  # documents that costs and selectivities are estimated on
SEED = 20


class Text:
    """A document's text with its features, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.known: dict = {}

    def __getattr__(self, name):
        if name not in FEATURES:
            raise AttributeError(name)
        value = self.known.get(name)
        if value is None:
            value = self.known[name] = FEATURES[name](self)
        return value


def _n_dup_lines(t: Text) -> int:
    lines = [x for x in t.text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(words: list[bytes], width: int = REPEAT) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    if len(words) <= width or len(set(words)) == len(words):
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], "i8")
    n = len(ids) - width + 1
    # Number the windows by doubling up exact pairs: (window of j words, next word).
    window = ids[:n]
    for j in range(1, width):
        _, window = np.unique(window * (len(number) + 1) + ids[j:j + n], return_inverse=True)
    twice = np.bincount(window)[window] > 1
    covered = np.zeros(len(ids) + 1, "i8")
    at = np.flatnonzero(twice)
    covered[at] += 1
    np.subtract.at(covered, at + width, 1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def _top_word_share(t: Text) -> float:
    return max(Counter(t.words).values()) / len(t.words) if t.words else 0.0


def _upper_share(t: Text) -> float:
    letters = sum(map(str.isalpha, t.text))
    return sum(map(str.isupper, t.text)) / letters if letters else 0.0


FEATURES: dict[str, Callable] = {
    "words": lambda t: t.text.encode("utf-8", "surrogatepass").split(),
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.text) - sum(map(t.text.count, " \t\n\v\f\r")),
    "n_symbols": lambda t: sum(map(t.text.count, SYMBOLS)),
    "n_dup_lines": _n_dup_lines,
    "n_lines": lambda t: t.text.count("\n") + 1,
    "n_repeat_words": lambda t: repeated_words(t.words),
    "n_marks": lambda t: t.text.count("!") + t.text.count("?"),
    "top_word_share": _top_word_share,
    "upper_share": _upper_share,
}

#: The steps of the features that only rules need; all others are computed for every document.
COSTS: dict[str, Callable[[Text], float]] = {
    "n_lines": lambda t: 0.2 * len(t.text),
    "n_marks": lambda t: 0.3 * len(t.text),
    "top_word_share": lambda t: 24 * len(t.words),
    "upper_share": lambda t: 6 * len(t.text),
}


@dataclass
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    features: list[str] = field(default_factory=list)

    def cost(self, t: Text) -> float:
        """Steps on a document whose base features are known."""
        return 1 + sum(COSTS[f](t) for f in self.features if f in COSTS)


BASE = [
    Rule("too_short", lambda t: t.n_words < LEAST_WORDS, ["n_words"]),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > MOST_REPEATED * t.n_words, ["n_repeat_words", "n_words"]),
]

#: What ordinary prose passes with a wide margin.
RULES = [
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words, ["n_symbols", "n_words"]),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines > 3 * t.n_lines, ["n_dup_lines", "n_lines"]),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words, ["word_chars", "n_words"]),
    Rule("marks", lambda t: 5 * t.n_marks > t.n_words, ["n_marks", "n_words"]),
    Rule("one_word", lambda t: 10 * t.top_word_share > 3, ["top_word_share"]),
    Rule("shouting", lambda t: 2 * t.upper_share > 1, ["upper_share"]),
]


def sampled(documents: DataFrame, base: list[Rule], rules: list[Rule], sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """What each rule says of each sampled document that passes the ``base`` rules, and what it
    costs there.  About ``sample`` documents are drawn, each by a draw of its own."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rejected, cost = [], []
            for text in batch.column(0).to_pylist():
                one = Text(text)
                if not any(r.rejects(one) for r in base):
                    rejected.append([bool(r.rejects(one)) for r in rules])
                    cost.append([float(r.cost(one)) for r in rules])
            yield pa.record_batch(
                [pa.array(rejected, pa.list_(pa.bool_())), pa.array(cost, pa.list_(pa.float64()))], ["rejected", "cost"])

    share = min(1.0, sample / max(1, documents.count()))
    drawn = documents.select(F.col("text").cast("string").alias("text"))
    drawn = drawn.sample(share, SEED) if share < 1 else drawn
    found = drawn.mapInArrow(measure, "rejected array<boolean>, cost array<double>").collect()
    shape = len(found), len(rules)
    return (np.array([r.rejected for r in found], bool).reshape(shape), np.array([r.cost for r in found]).reshape(shape))


def ordered(rules: list[Rule], rejected: np.ndarray, cost: np.ndarray) -> list[Rule]:
    """The best rule by rejection per cost, then the best on what it leaves, and so on; ties as
    given."""
    left, order = list(range(len(rules))), []
    rows = np.ones(len(rejected), bool)
    while left:
        worth = [rejected[rows, k].sum() / max(cost[rows, k].sum(), 1e-9) for k in left]
        best = left[int(np.argmax(worth))]
        left.remove(best)
        order.append(rules[best])
        rows &= ~rejected[:, best]
    return order


def judge(documents: DataFrame, base: list[Rule] = BASE, rules: list[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Per row: ``doc_id``, the base features, ``base_failed``, ``kept``, and
    ``rules_run``, how many rules of the cascade it took."""
    order = ordered(rules, *sampled(documents, base, rules, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                t = Text(text)
                failed = any(r.rejects(t) for r in base)
                kept, n = not failed, 0
                if kept:
                    for rule in order:
                        n += 1
                        if rule.rejects(t):
                            kept = False
                            break
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept, n))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rules_run"])

    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, rules_run long")
