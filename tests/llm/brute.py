"""Plain Python forms of the corpus operators, one text after the other."""

import collections
import hashlib
import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return WORD.findall(s or "")


def model(texts):
    counts = collections.Counter()
    for t in texts:
        counts.update([*words(lower(t)), None])
    return counts


def base_score(counts, text):
    total, vocabulary = sum(counts.values()), len(counts)
    tokens = [*words(lower(text)), None]
    return len(tokens), sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 1) / (total + vocabulary + 1)) for w in tokens)


def lm_score(texts, text, order, base, mu):
    """log10 p under counts quantised as the filter has them: least counts of n-grams, largest ones of histories."""
    q = lambda c: 1 + math.floor(math.log(c) / math.log(base) + 1e-9)
    least = lambda c: math.ceil(base ** (q(c) - 1) - 1e-9) if c else 0
    most = lambda c: math.ceil(base ** q(c) - 1e-9) - 1 if c else 0
    counts, total = collections.Counter(), 0
    split = lambda t: ["<s>", *words(lower(t)), None]
    for t in texts:
        w = split(t)
        total += len(w) - 1
        counts.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    vocabulary = sum(len(k) == 1 and k != ("<s>",) for k in counts)
    w, out = split(text), 0.0
    for i in range(1, len(w)):
        p = (least(counts[(w[i],)]) + 1) / (total + vocabulary + 1)
        for n in range(2, min(order, i + 1) + 1):
            c, h = least(counts[tuple(w[i - n + 1 : i + 1])]), most(counts[tuple(w[i - n + 1 : i])])
            p = (c + mu * p) / (max(h, c) + mu)
        out += math.log10(p)
    return out


def fingerprint(text, n=3):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(points, near):
    """The least member of each point's component."""
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def without_repeats(rows, window):
    first, split = {}, [(i, words(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_run(item, text):
    """The least edit distance of an item to a run of a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)
