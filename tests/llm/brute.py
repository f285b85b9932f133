"""Plain forms of the text operators for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DARK = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOW))


def dark(text, lower=True):
    return DARK.findall((text or "").translate(LOW) if lower else text or "")


def contamination(docs, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[s:s + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        out.append((doc, len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return out


def phrase_places(text, phrases):
    w, found = alnum(text), []
    for label, phrase in phrases:
        p = phrase.split()
        found += [(s, label) for s in range(len(w) - len(p) + 1) if w[s:s + len(p)] == p]
    return len(w), found


def near_duplicates(docs, size, percent):
    sets = []
    for _, text in docs:
        w = dark(text)
        sets.append({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and None not in (docs[i][0], docs[j][0]) and 100 * len(a & b) >= percent * len(a | b):
                group[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(docs):
        low[root(i)] = doc if low.get(root(i)) is None else min(low[root(i)], doc)
    return [(doc, len(sets[i]), low[root(i)], doc == low[root(i)]) for i, (doc, _) in enumerate(docs)]


def repeated_bytes(docs, length):
    """doc, bytes, removed, spans, kept for each row."""
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(docs, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def earlier_passages(docs, window):
    """doc, words, removed, kept for each row."""
    first = {}
    for doc, text in docs:
        w = dark(text, False)
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            if doc is not None:
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in docs:
        w = dark(text, False)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[p:p + window])] < doc:
                gone[p:p + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out
