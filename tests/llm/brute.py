"""Plain versions of the operators: small, slow, obviously right."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, size):
    own = words(text)
    if len(own) >= size:
        return {tuple(own[n : n + size]) for n in range(len(own) - size + 1)}
    return {tuple(own)} if own else set()


def similar(x, y, percent):
    same = len(x & y)
    return bool(same) and 100 * same >= percent * (len(x) + len(y) - same)


def groups(rows, size, percent=80):
    """doc_id to (set size, component)."""
    sets = {doc: shingles(text, size) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for doc in sorted(sets):
        for shingle in sets[doc]:
            lists[shingle].append(doc)
    pairs = {(a, b) for members in lists.values() for n, a in enumerate(members) for b in members[n + 1 :]}
    for a, b in pairs:
        if similar(sets[a], sets[b], percent):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {doc: (len(own), root(doc)) for doc, own in sets.items()}


def lines(rows, percent=80):
    """doc_id to the lines that stay."""
    seen, out = [], {}
    for doc, text in sorted(rows):
        stay = []
        for line in (text or "").split("\n"):
            own = set(words(line))
            if not own or not any(similar(own, other, percent) for other in seen):
                stay.append(line)
            if own:
                seen.append(own)
        out[doc] = None if text is None else "\n".join(stay)
    return out


def repeats(rows, length=50):
    """doc_id to (kept bytes, number of removed runs)."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        own = [data[n : n + length] for n in range(len(data) - length + 1)]
        gone = [False] * len(data)
        for n, window in enumerate(own):
            if window in seen:
                gone[n : n + length] = [True] * length
        seen.update(own)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = kept, sum(g and not before for g, before in zip(gone, [False, *gone]))
    return out


def contaminated(rows, items, window=13):
    """doc_id to (words, hit words, item ids)."""
    def own_words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    patterns = defaultdict(set)
    for item, text in items:
        own = own_words(text)
        for n in range(max(1, len(own) - window + 1) if own else 0):
            patterns[tuple(own[n : n + window])].add(str(item))
    out = {}
    for doc, text in rows:
        own, hit, found = own_words(text), set(), set()
        for pattern, ids in patterns.items():
            for n in range(len(own) - len(pattern) + 1):
                if tuple(own[n : n + len(pattern)]) == pattern:
                    hit.update(range(n, n + len(pattern)))
                    found |= ids
        out[doc] = len(own), len(hit), sorted(found)
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
