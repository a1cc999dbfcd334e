"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    """``{row: (keep_id, size, kept, sha)}`` by position."""
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = []
    for i, t in docs:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i is not None and i == keep, sha(t or "")))
    return out


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near(docs, width, percent):
    """``{doc_id: (n_shingles, component, kept)}`` by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in docs}
    union, held = Union(sets), collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for s in sets[i] for j in held[s])
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                union.join(i, j)
        for s in sets[i]:
            held[s].append(i)
    return {i: (len(s), union.find(i), union.find(i) == i) for i, s in sets.items()}


def repeats(docs, window):
    """``{doc_id: (n_words, n_removed, kept text)}``."""
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), b" ".join(w[k] for k in range(len(w)) if k not in gone).decode())
    return out


def luhn(digits):
    return sum((d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def personal(text):
    """Counts by kind, and the spans as a line."""
    found = [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text) if holds(k, m[0])]
    n = collections.Counter(k for k, _, _ in found)
    return tuple(n[k] for k, _ in BASE), ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def auc(scores, labels):
    order = sorted(range(len(scores)), key=scores.__getitem__)
    rank = {k: r for r, k in enumerate(order)}
    ones = [k for k, y in enumerate(labels) if y]
    return (sum(rank[k] for k in ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * (len(labels) - len(ones)))
