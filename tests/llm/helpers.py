"""Plain Python versions of what the operators give, written from their contracts alone."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def remainder(doc_id, modulus):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % modulus


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text):
    words = [w for w in SPACE.split(lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """Smallest id reachable, per id; every pair is looked at."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def hit_words(text, windows):
    words = WORD.findall(lower(text))
    hit, items = set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            found = windows.get(tuple(words[i : i + n]))
            if found:
                hit.update(range(i, i + n))
                items |= found
    return len(words), len(hit), items


def benchmark_windows(items, size=10):
    out = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            out.setdefault(tuple(words[i : i + n]), set()).add(item)
    return out


def token_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        if remainder(doc_id, 10):
            counts.update([w for w in SPACE.split(lower(text)) if w] + [None])
    return counts
