"""Words and word windows of a batch of texts, as 64-bit hashes, by whole-array operations."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each text starts (and the
    last one ends).  A null counts as empty."""
    if column.type != pa.large_binary():
        column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "i8")[column.offset:column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, "u1"), np.zeros(len(column) + 1, "i8")
    return np.frombuffer(data, "u1")[at[0]:at[-1]], at - at[0]


class Hasher:
    """Hashes spans of bytes; keeps the powers it needs from batch to batch."""

    def __init__(self):
        self.power = np.ones(1, "u8")
        self.inverse = np.ones(1, "u8")

    def _grow(self, n: int) -> None:
        if len(self.power) < n + 1:
            n = max(n, 1 << 16)
            for name, base in (("power", _BASE), ("inverse", _INVERSE)):
                steps = np.full(n + 1, base, "u8")
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype="u8"))

    def spans(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A hash of data[start:stop] for each span; equal spans have equal hashes."""
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, "u8")
        np.cumsum((data.astype("u8") + np.uint64(1)) * self.power[:len(data)], out=sums[1:])
        plain = (sums[stops] - sums[starts]) * self.inverse[starts]
        return mixed(plain + (stops - starts).astype("u8") * np.uint64(_BASE))


def ascii_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed, return:
    starts, stops, and the number of the text each lies in."""
    inside = np.ones(len(data) + 1, bool)
    inside[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    inside[-1] = False
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[at] = False  # a word ends with its text
    starts = np.flatnonzero(inside & ~before)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    after_inside = np.zeros(len(data) + 1, bool)
    after_inside[1:] = inside[:-1]
    stops = np.flatnonzero(after_inside & (~inside | edge))
    return starts, stops, np.searchsorted(at, starts, "right") - 1


def windows(hashes: np.ndarray, text: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of one text, and their text; a text of fewer
    words, but not none, is one run as a whole."""
    n = len(hashes)
    per_text = np.bincount(text, minlength=n_texts)
    first = np.cumsum(per_text) - per_text
    place = np.arange(n) - first[text]
    total = np.zeros(n, "u8")
    for j in range(width):
        there = hashes[np.minimum(np.arange(n) + j, max(n - 1, 0))] if n else hashes
        part = mixed(there + np.uint64((j + 1) * _BASE & (1 << 64) - 1))
        total = np.where(place + j < per_text[text], total * np.uint64(_BASE) + part, total)
    keep = (place + width <= per_text[text]) | ((place == 0) & (per_text[text] < width))
    whole = np.minimum(per_text[text], width).astype("u8")
    return mixed(total[keep] + whole[keep]), text[keep]


def distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, texts in order."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype("u1")


def shingle_sets(column: pa.Array, hasher: Hasher, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word windows of each text, lower-cased: hashes and text numbers."""
    data, at = raw_texts(column)
    data = lowered(data)
    starts, stops, text = ascii_words(data, at)
    return distinct(*windows(hasher.spans(data, starts, stops), text, len(column), width))
