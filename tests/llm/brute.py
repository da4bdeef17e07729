"""The operators' results worked out plainly, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

_low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_low))


def shingles(text: str | None, size: int = 5) -> set:
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def jaccard_components(docs: dict) -> dict:
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in docs:
        for b in docs:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def repeats(docs: dict, length: int = 100) -> dict:
    seen, out = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def kneser_ney(docs: dict, held_out) -> dict:
    tokens = {d: [*words(t), "end"] for d, t in docs.items()}
    uni, pairs = Counter(), Counter()
    for d, t in tokens.items():
        if not held_out(d):
            uni.update(t)
            pairs.update(zip(["begin", *t[:-1]], t))
    total, distinct = sum(uni.values()), len(uni)

    def discounts(counts):
        n1, n2, n3, n4 = (sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4))
        if not n1 or not n2:
            return [0, 0.5, 0.5, 0.5]
        y = n1 / (n1 + 2 * n2)
        d3 = 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2
        return [0, min(1, max(0, 1 - 2 * y * n2 / n1)), min(2, max(0, 2 - 3 * y * n3 / n2)), min(3, max(0, d3))]

    lefts = Counter(w for _, w in pairs)
    d2, d1, types = discounts(pairs), discounts(lefts), len(pairs)
    unseen = sum(d1[min(c, 3)] for c in lefts.values()) / types / (distinct + 1)
    after, mass = Counter(), defaultdict(float)
    for (v, _), c in pairs.items():
        after[v] += c
        mass[v] += d2[min(c, 3)]

    def p(v, w):
        low = (lefts[w] - d1[min(lefts[w], 3)]) / types + unseen
        c = pairs[v, w]
        return (c - d2[min(c, 3)]) / after[v] + mass[v] / after[v] * low if after[v] else low

    out = {}
    for d, t in tokens.items():
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        out[d] = (len(t), sum(uni[w] > 0 for w in t), total, base, sum(math.log10(p(v, w)) for v, w in zip(["begin", *t[:-1]], t)))
    return out


def crc_bucket(doc_id, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus
