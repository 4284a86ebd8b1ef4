"""Plain versions of what the operators compute."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def simhash(t):
    w = WORD.findall(low(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingled(t, size):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similar(one, two):
    """Jaccard similarity of 0.8 or more; two empty sets are equal."""
    return one == two or 5 * len(one & two) >= 4 * len(one | two)


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def secret_spans(t):
    found = [(m.start(), k, m.end()) for k, (_, r, g, least) in enumerate(KINDS) for m in r.finditer(t) if len(m[g]) >= least]
    return ",".join(f"{KINDS[k][0]}:{b}:{e}" for b, k, e in sorted(found))


def canonical(t):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(t).casefold())).strip()


def removed_words(docs, window):
    """(id, text) -> {id: (words, kept words)}; ids are distinct."""
    first = {}
    for i, t in sorted(docs):
        w = WORD.findall(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in docs:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (w, [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def unigram(docs):
    """{id: (held out, tokens, known, total, score)}"""
    words = {i: [*WORD.findall(low(t)), "\0end"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}
