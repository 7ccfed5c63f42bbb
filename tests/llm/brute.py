"""Plain Python versions of the operators, for small inputs."""

import hashlib
import random
import re
from collections import defaultdict

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LICENSES = {"gpl": b"gnu general public license", "apache": b"apache license", "cc-by": b"cc by", "mit": b"mit license"}


def lowered(text):
    return (text or "").encode().lower()


def words(text):
    return WORD.findall(lowered(text))


def shingles(text, n=5):
    w = lowered(text).split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(docs, percent):
    sets = {d: shingles(t) for d, t in docs if d is not None}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(ids, pairs)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def dedup_lines(docs, edits=2, least=20):
    """docs in order of (id, None last); rows of one id are one place."""
    lines, out = [], []
    ordered = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    places = {}
    for i in ordered:
        for n, x in enumerate((docs[i][1] or "").split("\n")):
            place = (docs[i][0] is None, docs[i][0] or 0, n)
            b = x.encode()
            if len(b) >= least:
                lines.append((place, b, i, n))
    gone = defaultdict(set)
    lines.sort(key=lambda x: x[0])
    first = {}
    for place, b, _, _ in lines:
        first.setdefault(b, place)
    order = sorted(first, key=lambda b: (first[b], 0))
    near = {b for k, b in enumerate(order) if any(abs(len(a) - len(b)) <= edits and first[a] < first[b] and edit(a, b) <= edits for a in order[:k])}
    for place, b, i, n in lines:
        if b in near or place != first[b]:
            gone[i].add(n)
    for i, (d, t) in enumerate(docs):
        out.append((d, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]), sorted(gone[i])))
    return out


def contamination(text, items, width=13):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        own = words(t)
        n = min(width, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), hit, sorted(found)


def repeats(docs, window=50):
    """(id, bytes, removed, spans, digest of the rest), in the order of docs."""
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - window + 1) if d is not None else ():
            s = b[i:i + window]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - window + 1) if d is not None else ():
            if first[b[i:i + window]] < d:
                gone |= set(range(i, i + window))
        spans = sum(i in gone and i - 1 not in gone for i in range(len(b)))
        out.append((d, len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
    return out


def license_places(text):
    w = words(text)
    return sorted((i, name) for name, p in LICENSES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


def crowd(share, apart, alone=70, pairs=40):
    """Texts of which all share `share` of 200 words, and of these `pairs` pairs that differ in their last `apart` words only."""
    rng = random.Random(4)
    new = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    base, own = new(int(200 * share)), 200 - int(200 * share)
    texts = [base + new(own) for _ in range(alone)]
    for _ in range(pairs):
        tail = new(own - apart)
        texts += [base + tail + new(apart), base + tail + new(apart)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]
