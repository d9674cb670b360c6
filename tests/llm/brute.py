"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict


def repeated(rows, length=200):
    """[(doc_id, n_bytes, n_removed, n_spans, sha256)] of [(doc_id, text)]."""
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def near(rows, words=3, percent=85):
    """[(doc_id, n_shingles, component_id)] of [(doc_id, text)]: every pair with a common shingle is compared."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = ({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}) if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    common = Counter()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[(a, b)] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets.items())
