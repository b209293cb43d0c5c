"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact(rows):
    """doc_id -> (keep_id, group_size, kept, sha) for rows (doc_id, text) with distinct ids."""
    groups = defaultdict(list)
    for k, t in rows:
        groups[plain(t)].append((k, t or ""))
    out = {}
    for p, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        for k, _ in members:
            out[k] = (keep, len(members), k == keep, hashlib.sha256(p.encode()).hexdigest())
    return out


def repeats(rows, size=50):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    first = {}
    for k, t in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            first[x] = min(first.get(x, k), k)
    out = {}
    for k, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def lower(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, size):
    w = words(lower(text))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near(rows, size, percent):
    """doc_id -> (n_shingles, component_id)."""
    sets = {k: shingle_set(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    by = defaultdict(set)
    for k in ids:
        for s in sets[k]:
            by[s].add(k)
    for k in ids:
        for o, n in Counter(o for s in sets[k] for o in by[s] if o < k).items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[o]) - n):
                a, b = find(k), find(o)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in ids}


def quality(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), base
