"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rules(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def exact(rows):
    """{row index: (keep_id, size, sha)} for (doc_id, text) rows."""
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id or 0, k))
    out = {}
    for norm, members in groups.items():
        first = min(members)
        for m in members:
            out[m[2]] = (None if first[0] else first[1], len(members), hashlib.sha256(norm.encode()).hexdigest())
    return out


def shingles(text):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near(rows, percent=85):
    """{doc_id: (n_shingles, component_id)} for (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    common = Counter()
    for members in by.values():
        members.sort()
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by water filling, for {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    full = set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(w[s] for s in order if s not in full)
        out = {s: most * sizes[s] if s in full else w[s] * rest / open_ for s in order}
        more = {s for s in order if s not in full and out[s] > most * sizes[s] + 1e-9}
        if not more:
            return out
        full |= more


def piece_ids(tokenizer, text, capacity=2048):
    """[(piece, start, length, crc)] of a document."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
    return [
        (k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
    ]
