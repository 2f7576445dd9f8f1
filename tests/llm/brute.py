"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def contaminated(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (those := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= {str(i) for i in those if i is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs, distance=4):
    prints = [simhash(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(docs)]


def without_repeats(docs, length=50):
    words = [(t or "").encode().split() for _, t in docs]
    first = {}
    for (doc_id, _), w in zip(docs, words, strict=True):
        for s in range(len(w) - length + 1 if doc_id is not None else 0):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = set()
        for s in range(len(w) - length + 1 if doc_id is not None else 0):
            if first[tuple(w[s : s + length])] < doc_id:
                gone.update(range(s, s + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def ngram_scores(docs, order, discount=0.75):
    """Absolute discounting at each order, interpolated down to the smoothed unigram; counts of tuples of words."""
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]

    def contexts(words, k):  # the k words before each word; "" stands before the first
        padded = [""] * k + words
        return [tuple(padded[i : i + k]) for i in range(len(words))]

    seen = [Counter() for _ in range(order)]
    for doc_id, text in docs:
        if fold(doc_id, 5) != 1:
            w = tokens(text)
            for k in range(order):
                seen[k].update(zip(contexts(w, k), w, strict=True))
    n, v = sum(seen[0].values()), len(seen[0])
    total, kinds = [Counter() for _ in seen], [Counter() for _ in seen]
    for k, grams in enumerate(seen):
        for (before, _), times in grams.items():
            total[k][before] += times
            kinds[k][before] += 1
    out = []
    for doc_id, text in docs:
        w, base, score = tokens(text), 0.0, 0.0
        before = [contexts(w, k) for k in range(order)]
        for i, word in enumerate(w):
            p = (seen[0][(), word] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(1, order):
                here = before[k][i]
                if total[k][here]:
                    share = max(seen[k][here, word] - discount, 0) / total[k][here]
                    p = share + discount * kinds[k][here] / total[k][here] * p
            score += math.log10(p)
        out.append((doc_id, fold(doc_id, 5) == 1, len(w), sum(seen[0][(), x] > 0 for x in w), n, base, score))
    return out


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[: len(words) - q] == words[q:])


def runs(words, least=12):
    """By the definition: for each q the widest stretches whose words q apart are equal."""
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and smallest_period(words[i : j + q]) == q:
                found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic(docs):
    out = []
    for doc_id, text in docs:
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs(w)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join("%d,%d,%d\n" % r for r in found)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
        out.append((doc_id, len(found), s, length, q, 1000 * length // q if q else None, *digests))
    return out


def targets(sizes, weights=(3, 1, 2)):
    """Target by source, {source: words} given; what one cannot use is shared out again."""
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return {s: share.get(s, 2.0 * sizes[s]) for s in order}
        full |= above
