"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def fold(doc_id, folds):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def repeats(rows, length=200):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[k : k + length] for k in range(len(data) - length + 1))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if seen[data[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        kept = bytes(x for x, y in zip(data, mask, strict=True) if not y)
        out.append((doc_id, len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = {doc_id: shingles(text) for doc_id, text in rows}
    holders = defaultdict(list)
    for doc_id, found in sets.items():
        for shingle in found:
            holders[shingle].append(doc_id)
    shared = Counter()
    for ids in holders.values():
        ids.sort()
        shared.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    parent = {doc_id: doc_id for doc_id in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {(doc_id, len(found), root(doc_id)) for doc_id, found in sets.items()}
