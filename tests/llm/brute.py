"""Plain Python versions of the operators, for small tables."""

import collections
import re


def words(text):
    return (text or "").encode().split()


def without_repeats(texts, width=35):
    seen = collections.Counter(tuple(x[i:i + width]) for x in map(words, texts) for i in range(len(x) - width + 1))
    out = []
    for x in map(words, texts):
        keep = [True] * len(x)
        for i in range(len(x) - width + 1):
            if seen[tuple(x[i:i + width])] > 1:
                keep[i:i + width] = [False] * width
        left = [w for w, k in zip(x, keep) if k]
        out.append((len(x), len(x) - len(left), b" ".join(left).decode()))
    return out


def shingles(text, n):
    x = (text or "").encode().lower().split()
    return {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if len(x) >= n else ({tuple(x)} if x else set())


def components(rows, n, num, den):
    """rows: (key, text); per row (key, set size, smallest key of its component)."""
    sets = [shingles(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(key, low.get(find(i), key))
    return [(key, len(sets[i]), low.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def base_counts(text):
    x = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(x[i:i + 8]) for i in range(len(x) - 7))
    covered = {j for i in range(len(x) - 7) if seen[tuple(x[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [y for y in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    return (len(x), sum(map(len, x)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
