"""Plain Python forms of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontaminate(docs, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        if item is None or not w:
            continue
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            wins[tuple(w[i : i + size])].add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for doc_id, text in docs:
        w, hit, found = item_words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if got := wins.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text, shingle=3):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hs = np.array([xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hs >> np.uint64(b)) & np.uint64(1)).sum()) > len(hs))


def near_duplicates(docs, shingle=3, distance=2):
    docs = list(docs)
    prints = np.array([fingerprint(t, shingle) for _, t in docs], dtype=np.uint64)
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= distance):
            parent[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f"{int(p):016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(docs, prints))]


def quality(text):
    text = text or ""
    w = words(text)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def repeats(docs, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256); docs in ascending doc_id order, None first."""
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def held_out(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest
