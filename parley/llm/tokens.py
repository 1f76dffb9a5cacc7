"""Token ids of whole texts by the public tokenizers, one look-up per distinct word.

The texts of a slice are cut into words by whole-array operations, where the tokenizer's own
pre-tokenizer always cuts, so the ids of a text are the ids of its words in a row.  Distinct
words are found by dictionary encoding; each is looked up among the words met before, whose
ids lie end to end in one array, and the ids of the slice are gathered from there.

* A vocabulary that keeps white space (byte-level BPE) is cut before a space that stands
  between two non-space characters; longer runs of white space give up all but their last
  character first, as the pre-tokenizer's pattern does.
* One that drops white space (BPE with word ends) is cut at every space and line feed.

ASCII punctuation that ends a word after a letter is a word of its own: the pre-tokenizers
always cut between a letter and a mark.

Words met for the first time go to the library together.  Words of Latin letters are joined
to one text: each is one pre-token, and the marks the vocabulary puts at a word's start or
end tell their ids apart.  A text that holds a special token's string, or white space beyond
ASCII that the vocabulary keeps, goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
import struct
import sys
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from parley.llm.words import raw_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The characters of Unicode's White_Space property beyond ASCII, which \s stands for too.
_WIDE_SPACE = re.compile(
    "[\N{NEXT LINE}\N{NO-BREAK SPACE}\N{OGHAM SPACE MARK}\N{EN QUAD}-\N{HAIR SPACE}\N{LINE SEPARATOR}"
    "\N{PARAGRAPH SEPARATOR}\N{NARROW NO-BREAK SPACE}\N{MEDIUM MATHEMATICAL SPACE}\N{IDEOGRAPHIC SPACE}]")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
# The letters of two bytes that start with this one; the other two are signs.
_LATIN = 0xC3
_SIGNS = "\N{MULTIPLICATION SIGN}\N{DIVISION SIGN}"
_TOGETHER = 1000  # words joined to one text
CACHE_WORDS = 300_000
_MARK = np.isin(np.arange(256), np.frombuffer(_MARKS.encode(), "u1"))


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[start:start + size] of each, end to end."""
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    return pool[np.arange(total) + np.repeat(starts - (stops - sizes), sizes)]


class Encoder:
    """The ids of texts, as the library gives them without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer = self.tokenizer.normalizer
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space = len(self._whole([" "])[0]) > 0
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        known = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(known.values()) + 1, bool)  # ids that start a word, or end it
        for token, i in known.items():
            self.edge[i] = token.endswith(suffix) if suffix else token.startswith("\N{LATIN CAPITAL LETTER G WITH DOT ABOVE}")
        self.first_edge = not suffix
        every = "".join(chr(c) for c in range(0xC0, 0x100) if chr(c) not in _SIGNS)
        self.latin = not self.normalizer or self.normalizer.normalize_str(every).isalpha()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(1024, "i8"), np.zeros(1024, "i8")
        self.pool, self.used = np.zeros(1 << 14, "u4"), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Note the words' ids, given end to end."""
        n, at = len(self.known), self.used
        while n + len(words) > len(self.starts):
            self.starts, self.sizes = (np.resize(x, 2 * len(x)) for x in (self.starts, self.sizes))
        while at + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[at:at + len(ids)] = ids
        self.sizes[n:n + len(words)] = sizes
        self.starts[n:n + len(words)] = at + np.cumsum(sizes) - sizes
        self.used = at + len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _learn(self, words: pa.Array) -> None:
        """Look words up in the library that are not known yet."""
        plain = self._plain(words)
        rest = words.filter(pa.array(~plain)).to_pylist()
        words = words.filter(pa.array(plain)).to_pylist()
        # Words of a vocabulary that keeps spaces begin with theirs.
        lead = b"" if self.keeps_space else b" "
        texts = [lead.join(words[i:i + _TOGETHER]).decode() for i in range(0, len(words), _TOGETHER)]
        ids = np.concatenate([np.zeros(0, "u4"), *(np.array(x, "u4") for x in self._whole(texts))]) if texts else np.zeros(0, "u4")
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) == len(words):
            cuts = np.append(edges, len(ids)) if self.first_edge else np.append(-1, edges)
            self._keep(words, ids, np.diff(cuts))
        else:  # they cannot be told apart
            rest += words
        found = self._whole([w.decode() for w in rest]) if rest else []
        self._keep(rest, np.array([i for x in found for i in x], "u4"), np.array([len(x) for x in found], "i8"))

    def _letters(self, data: np.ndarray) -> np.ndarray:
        """Which bytes belong to ASCII letters, or to the common letters of two bytes."""
        ascii_ = ((data | 32) >= 97) & ((data | 32) <= 122)
        if not self.latin:
            return ascii_
        second = (data >= 0x80) & (data < 0xC0)
        for sign in _SIGNS:
            second &= data != sign.encode()[1]
        lead = data == _LATIN
        return ascii_ | (lead & np.append(second[1:], False)) | (second & np.append(False, lead[:-1]))

    def _plain(self, words: pa.Array) -> np.ndarray:
        """Which words are one pre-token of such letters, behind a space if the vocabulary keeps it."""
        data, at = raw_texts(words)
        data = np.append(data, np.uint8(0))
        good = np.append(0, np.cumsum(self._letters(data)))
        first = at[:-1] + self.keeps_space
        n = at[1:] - first
        return (n > 0) & (good[at[1:]] - good[np.minimum(first, at[1:])] == n) & ((data[at[:-1]] == 32) | (not self.keeps_space))

    def _tails(self, data: np.ndarray, at: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Where marks start that end a word after a letter."""
        mark = _MARK[data]
        ends = np.append(space[1:], True)
        ends[at[1:-1][at[1:-1] > 0] - 1] = True
        # A mark belongs to a tail if only marks stand between it and the word's end.
        letter = np.append(False, self._letters(data)[:-1])[:len(data)]
        letter[at[:-1][at[:-1] < len(data)]] = False
        tails = np.flatnonzero(mark & letter)
        other = np.flatnonzero(~mark | ends)  # the last place of data is one
        nearest = other[np.searchsorted(other, tails)]
        found = np.zeros(len(data), bool)
        found[tails[mark[nearest] & ends[nearest]]] = True
        return found

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of the texts, and the number of the text each lies in."""
        if self.keeps_space:
            space = (data == 32) | ((data >= 9) & (data <= 13))
            first = np.zeros(len(data) + 1, bool)
            first[at] = True  # a text starts
            behind = first[1:].copy()  # a text ends with this byte
            first = first[:-1]
            before = np.empty(len(data), bool)
            before[:1], before[1:] = False, space[:-1]
            after = np.append(~space[1:], False) & ~behind  # another character stands behind, no space
            plain_space = np.append(False, data[:-1] == 32)
            first |= space & (~before | after)
            first |= ~space & before & ~plain_space
            first |= self._tails(data, at, space)
            starts = np.flatnonzero(first)
            offsets = np.append(starts, len(data))
        else:
            inside = (data != 32) & (data != 10)
            before = np.zeros(len(data) + 1, bool)
            before[1:] = inside
            before[at] = False
            starts = np.flatnonzero((inside & ~before[:-1]) | self._tails(data, at, ~inside))
            offsets = np.append(np.cumsum(inside, dtype="i8")[starts] - 1, np.count_nonzero(inside))
            data = data[inside]
        words = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype("i8")), pa.py_buffer(np.ascontiguousarray(data))])
        return words, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))

    def _cut_and_looked_up(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = raw_texts(column)
        words, text = self._cut(data, at)
        if len(self.known) > CACHE_WORDS:
            self._forget()
        coded = pc.dictionary_encode(words)
        distinct = coded.dictionary.to_pylist()
        found = np.fromiter(map(self.known.get, distinct, repeat(-1)), "i8", len(distinct))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            self._learn(coded.dictionary.take(pa.array(missing)))
            found[missing] = [self.known[distinct[i]] for i in missing.tolist()]
        number = found[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[number]
        counts = np.bincount(text, weights=sizes, minlength=len(column)).astype("i8")
        return gathered(self.pool, self.starts[number], sizes), counts

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and their number in each text (null: none)."""
        column = column.fill_null("")
        odd = np.zeros(len(column), bool)
        for special in self.special:
            odd |= pc.match_substring(column, special).to_numpy(zero_copy_only=False)
        if self.keeps_space:
            data, at = raw_texts(column)
            lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
            for i in np.unique(np.searchsorted(at, lead, "right") - 1).tolist():
                odd[i] = odd[i] or _WIDE_SPACE.search(column[i].as_py()) is not None
        if not odd.any():
            return self._cut_and_looked_up(column)
        ids, counts = self._cut_and_looked_up(column.filter(pa.array(~odd)))
        whole = self._whole(column.filter(pa.array(odd)).to_pylist())
        pool = np.concatenate([ids, *(np.array(x, "u4") for x in whole)])
        sizes = np.zeros(len(column), "i8")
        sizes[~odd], sizes[odd] = counts, [len(x) for x in whole]
        order = np.argsort(odd, kind="stable")  # where each text lies in the pool
        starts = np.empty(len(column), "i8")
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return gathered(pool, starts, sizes), sizes

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        ids, _ = self.encode_column(pa.array([text], pa.string()))
        return struct.pack(f"<{len(ids)}I", *ids.tolist())

    def encode_ended(self, column: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        """Each text's ids and ``end_id`` behind them, packed, and how many these are."""
        ids, counts = self.encode_column(column)
        counts = counts + 1
        stops = np.cumsum(counts)
        ended = np.full(int(stops[-1]) if len(stops) else 0, end_id, "<u4")
        own = np.ones(len(ended), bool)
        own[stops - 1] = False
        ended[own] = ids
        offsets = np.append(0, stops * 4).astype("i4")
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ended)]), counts


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary; Spark reuses the processes."""
    cache = sys.modules.setdefault("_parley_encoders", type(sys)("_parley_encoders")).__dict__
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
