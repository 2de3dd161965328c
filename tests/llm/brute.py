"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

BLANK = re.compile("[\x20\x09-\x0d]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return [w for w in BLANK.split(s or "") if w]


def substring(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0]))
    split = {k: words(x) for k, x in rows}
    order = {k: i for i, (k, _) in enumerate(rows)}
    first = {}
    for k, _ in rows:
        for i in range(len(split[k]) - 19):
            first.setdefault(tuple(split[k][i : i + 20]), (order[k], i))
    out = {}
    for k, _ in rows:
        w = split[k]
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (order[k], i):
                gone[i : i + 20] = [True] * 20
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def suffix(rows):
    rows = list(dict(rows).items())
    counts = Counter()
    for _, x in rows:
        b = (x or "").encode()
        counts.update(b[i : i + 200] for i in range(len(b) - 199))
    out = {}
    for k, x in rows:
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def shingles(x):
    w = words(lower(x or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(rows):
    sets = {k: shingles(x) for k, x in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in sorted(sets.items()):
        common = Counter(o for x in s for o in where[x])
        for o, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = sorted((root(k), root(o)))
                parent[b] = a
        for x in s:
            where[x].append(k)
    return {k: (len(s), root(k), root(k) == k) for k, s in sets.items()}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items):
    patterns = defaultdict(set)
    for k, x in items:
        w = WORD.findall(lower(x or ""))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            patterns[tuple(w[i : i + n])] |= set() if k is None else {str(k)}
    out = {}
    for k, x in rows:
        w = WORD.findall(lower(x or ""))
        hit, who = set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                if (found := patterns.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    who |= found
        out[k] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    return out
