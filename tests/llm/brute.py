"""Plain Python versions of the deduplication rules."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    parent, links = {i: i for i, _ in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(a), root(i), links[i]) for i, a in sets}


def cut(rows, least):
    """Every run of ``least`` characters or more that occurs earlier, by brute force over all runs."""
    split = lambda t: [(n, x.strip(" \t\n\v\f\r")) for n, x in enumerate((t or "").split("\n")) if WORD.search(x)]

    def runs(keys):
        for i in range(len(keys)):
            chars = 0
            for j in range(i, len(keys)):
                chars += len(keys[j])
                if chars >= least:
                    yield i, j + 1
                if chars >= 2 * least and j > i:  # a longer run is made of these
                    break

    first, out = {}, {}
    for doc, t in sorted(rows):
        keys = [x for _, x in split(t)]
        for i, j in runs(keys):
            first.setdefault(tuple(keys[i:j]), (doc, i))
    for doc, t in sorted(rows):
        held = split(t)
        keys = [x for _, x in held]
        gone = {held[k][0] for i, j in runs(keys) if first[tuple(keys[i:j])] != (doc, i) for k in range(i, j)}
        kept = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)
        out[doc] = (len(held), len(gone), t if t is None else kept)
    return out
