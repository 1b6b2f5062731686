"""Plain versions that several test modules compare with."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows):
    """Smallest id of each document's component, all pairs compared."""
    sets_ = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets_)):
        for b in range(a):
            (i, s), (j, t) = sets_[a], sets_[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets_}
