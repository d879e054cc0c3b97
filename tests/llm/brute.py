"""Plain versions of the operators' definitions, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

WORD = re.compile("[^\x20\x09-\x0d]+")


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def fingerprint(text: str | None, span: int = 3) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    span = min(span, len(words))
    shingles = [" ".join(words[i : i + span]) for i in range(len(words) - span + 1)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def simhash(rows: list[tuple]) -> dict:
    """doc_id to (hex fingerprint, component) for (doc_id, text) rows."""
    rows = sorted(rows)
    found = np.array([fingerprint(text) for _, text in rows], np.uint64)
    links = []
    for a in range(len(rows)):
        near = np.bitwise_count(found[a + 1 :] ^ found[a]) <= 2
        links += [(a, a + 1 + int(b)) for b in np.flatnonzero(near)]
    root = components(len(rows), links)
    return {r[0]: (f"{int(f):016x}", rows[root[i]][0]) for i, (r, f) in enumerate(zip(rows, found))}


def substring(rows: list[tuple], window: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, sha256 of the kept words), in the order of the rows."""
    words = [WORD.findall(text or "") for _, text in rows]
    seen = Counter(
        tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1)
    )
    found = []
    for (key, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(word for i, word in enumerate(w) if i not in gone)
        found.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return found


def overlap(words: list[str], item: list[str], window: int, substitutions: int):
    """(windows, covered words, equal words) at the best alignment, or None."""
    best = None
    for shift in range(-len(item) + 1, len(words)):
        agree = [
            0 <= shift + i < len(words) and words[shift + i] == item[i] for i in range(len(item))
        ]
        inside = [i for i in range(len(item)) if 0 <= shift + i < len(words)]
        if len(inside) < window:
            continue
        good = [
            i
            for i in range(inside[0], inside[-1] - window + 2)
            if sum(agree[i : i + window]) >= window - substitutions
        ]
        if good:
            covered = {i + k for i in good for k in range(window)}
            found = (len(good), len(covered), sum(agree[i] for i in covered))
            best = max(best or found, found)
    return best


def vectors(rows: list[tuple], threshold: float) -> dict:
    """vec_id to (n_links, component) for (vec_id, list) rows with distinct ids."""

    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    rows = sorted(rows)
    ok = [i for i, (_, v) in enumerate(rows) if usable(v)]
    links = []
    for at, i in enumerate(ok):
        for j in ok[at + 1 :]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links.append((i, j))
    n = Counter(i for link in links for i in link)
    root = components(len(rows), links)
    return {rows[i][0]: (n[i], rows[root[i]][0]) for i in range(len(rows))}
