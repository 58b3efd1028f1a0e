"""Plain versions of the operators, row by row."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def quality(text):
    text, w = text or "", words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    mark = [0] * len(w)
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            mark[i : i + 5] = [1] * 5
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            lines += 1
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, dup, sum(mark), lines, len(w) < 10 or 100 * sum(mark) > 20 * len(w)


def fingerprint(text):
    import xxhash

    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=4):
    """rows: (doc_id, fingerprint); the smallest id reachable, per row. Null ids are largest."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(rows))]


def key(doc):
    return float("inf") if doc is None else doc


def word_windows(rows, width=50):
    """rows: (doc_id, text) -> (n_words, n_removed, kept) per row."""
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            gram = tuple(w[i : i + width])
            first[gram] = min(first.get(gram, key(doc)), key(doc))
    out = []
    for doc, text in rows:
        w = words(text)
        mark = [0] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(doc):
                mark[i : i + width] = [1] * width
        out.append((len(w), sum(mark), " ".join(x for x, m in zip(w, mark) if not m)))
    return out


def byte_strings(rows, length=100):
    """rows: (doc_id, text) -> (n_bytes, n_removed, n_spans, kept) per row; other rows of the same id don't count."""
    least, places = {}, {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            least[s] = min(least.get(s, key(doc)), key(doc))
            places.setdefault((b, s), i)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if least[s] < key(doc) or places[b, s] < i:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out.append((len(b), sum(mark), spans, bytes(x for x, m in zip(b, mark) if not m)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def plain_words(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def shingles(w):
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def leaks(rows, items, least=0.8):
    """{(row number, item number): best similarity} over all item-sized windows."""
    out = {}
    cut = [plain_words(t) for t in items]
    for r, text in enumerate(rows):
        w = plain_words(text)
        for i, item in enumerate(cut):
            asked = Counter(shingles(item))
            if not asked:
                continue
            for s in range(max(1, len(w) - len(item) + 1)):
                held = Counter(shingles(w[s : s + len(item)]))
                both = sum((held & asked).values())
                score = both / (sum(held.values()) + sum(asked.values()) - both)
                if score >= least and score > out.get((r, i), 0):
                    out[r, i] = score
    return out


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())
