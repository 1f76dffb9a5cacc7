"""Plain versions of the operators, over lists of (doc_id, text)."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def near_duplicates(docs, width, percent=80):
    """doc_id -> (set sizes, least document reachable)."""
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    sets, first, index = defaultdict(list), {}, defaultdict(list)
    for d, text in docs:
        s = shingles(text, width)
        sets[d].append(len(s))
        if not s:
            continue
        if s in first:
            join(first[s], d)
            continue
        first[s] = d
        shared = Counter(o for x in s for o in index[x])
        for (other, size), n in shared.items():
            if 100 * n >= percent * (len(s) + size - n):
                join(other, d)
        for x in s:
            index[x].append((d, len(s)))
    return {d: (sorted(n), root(d)) for d, n in sets.items()}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, width=10):
    """[(doc_id, words, words hit, items)]"""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i:i + width])].add(item)
    sizes = {len(x) for x in windows}
    found = []
    for d, text in docs:
        w, hit, owners = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    owners |= windows[tuple(w[i:i + n])]
        found.append((d, len(w), len(hit), sorted(str(o) for o in owners if o is not None)))
    return found
