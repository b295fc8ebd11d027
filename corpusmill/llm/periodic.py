"""Periodic runs of words: maximal stretches whose words repeat at a distance, found by multi-scale minimizers.

Short periods are scanned directly: word against word at each lag, over many texts laid end to end. Longer periods are found scale by
scale. At scale Q (periods of Q to 2Q - 1) every run of Q/2 words has a name, equal for equal runs, and each window of
Q/2 + 1 such runs samples its smallest. A run of period q repeats its samples at distance q, so pairs of equal samples at such a distance
are its seeds; each seed is extended word by word (in doubling steps over names, without hashing).

Names of runs that are themselves periodic (period up to Q/4, known from the scales before) are never sampled. The rest cannot
repeat within Q/4 words, so a sample has at most a few partners and the work per scale is linear. What only periodic names could show is
a run whose first half lies in one shorter run and its second half in the next one, of the same period and touching it:
such neighbours are aligned directly, and each alignment is a run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.words import mix, small_batches, split_words, window_hashes

_LAGS = 32  # periods below are scanned directly; a power of two
_LEAST = 12  # a run has at least this many words
_CHUNK = 300_000  # words laid end to end at a time (one text is never cut)
RESULTS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def repeat_tail(words: list[bytes], key: int | None) -> list[bytes]:
    """Words with a periodic tail where 10 divides crc32 of the decimal ``key``: word i from a on becomes word a + (i - a) % p."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


class _Texts:
    """Word numbers of texts laid end to end, parted by numbers of their own; runs are (start, end, period) in that row."""

    def __init__(self, ids: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in ids], np.int64)
        self.starts = np.cumsum(np.r_[0, self.sizes[:-1] + 1]) if len(ids) else np.zeros(0, np.int64)
        self.x = np.empty(int(self.sizes.sum()) + len(ids), np.int64)
        for i, (at, part) in enumerate(zip(self.starts.tolist(), ids)):
            self.x[at:at + len(part)] = part
            self.x[at + len(part)] = -1 - i  # never equal to anything
        self.owner = np.repeat(np.arange(len(ids)), self.sizes + 1)

    def scan(self) -> np.ndarray:
        """Stretches of equal words at each short lag."""
        found = []
        for q in range(1, min(_LAGS, len(self.x))):
            equal = np.flatnonzero(self.x[q:] == self.x[:-q])
            need = max(q, _LEAST - q)
            if len(equal) < need or not (equal[need - 1:] - equal[:len(equal) - need + 1] == need - 1).any():
                continue
            cut = np.flatnonzero(np.diff(equal) > 1)
            first, last = equal[np.r_[0, cut + 1]], equal[np.r_[cut, len(equal) - 1]]
            long = last - first + 1 >= need
            found.append(np.stack([first[long], last[long] + 1 + q, np.full(int(long.sum()), q)], 1))
        return _distinct(found)


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    """Each stretch once, with its smallest period."""
    runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    same = (runs[1:, 0] == runs[:-1, 0]) & (runs[1:, 1] == runs[:-1, 1])
    return runs[np.r_[True, ~same]] if len(runs) else runs


class _Names:
    """``level(j)[i]``: a number of the ``2**j`` words from i on, equal for equal words; -1 where they pass the end of the row."""

    def __init__(self, x: np.ndarray):
        self.levels = [np.unique(x, return_inverse=True)[1].astype(np.int64)]

    def level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            out = np.full(len(low), -1, np.int64)
            n = len(low) - 2 * half + 1
            if n > 0:
                a, b = low[:n], low[half:half + n]
                out[:n] = np.unique(a * (int(low.max()) + 1) + b, return_inverse=True)[1]
            self.levels.append(out)
        return self.levels[j]

    def ahead(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many words from a < b on are equal; texts end in words that equal nothing."""
        out = np.zeros(len(a), np.int64)
        for j in range(most.bit_length() - 1, -1, -1):
            name, size = self.level(j), 1 << j
            ok = b + out + size <= len(name)
            left, right = name[np.where(ok, a + out, 0)], name[np.where(ok, b + out, 0)]
            out += np.where(ok & (left == right), size, 0)
        return out

    def behind(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many words before a < b are equal."""
        out = np.zeros(len(a), np.int64)
        for j in range(most.bit_length() - 1, -1, -1):
            name, size = self.level(j), 1 << j
            ok = a - out - size >= 0
            left, right = name[np.where(ok, a - out - size, 0)], name[np.where(ok, b - out - size, 0)]
            out += np.where(ok & (left == right), size, 0)
        return out


def _samples(names: np.ndarray, free: np.ndarray, width: int) -> np.ndarray:
    """Places whose name is the smallest (by a scrambled order) in some window of ``width`` places, periodic names apart."""
    if len(names) < width:
        return np.zeros(0, np.int64)
    value = np.where(free, mix(names.astype(np.uint64)) >> np.uint64(1), np.uint64(1 << 63)).astype(np.uint64)
    # Window minima from minima of windows of 1, 2, 4, ... places.
    low, size = value, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    least = np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
    # A place is sampled when a window over it has its value as minimum: the largest of these minima equals it.
    pad = np.full(width - 1, 0, np.uint64)
    high, size = np.concatenate([pad, least, pad]), 1
    while 2 * size <= width:
        high = np.maximum(high[:-size], high[size:])
        size *= 2
    most = np.maximum(high[:len(high) - rest], high[rest:]) if rest else high
    return np.flatnonzero(free & (most == value))


def _touching(names: _Names, runs: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(place, lag) for neighbours of one short period that touch: every lag that aligns the second with the first."""
    short = runs[(runs[:, 2] <= scale // 4) & (runs[:, 1] - runs[:, 0] >= scale)]
    out: list[tuple[int, int]] = []
    by_period: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in short.tolist():
        by_period.setdefault(p, []).append((s, e))
    x = names.levels[0]
    for p, found in by_period.items():
        found.sort()
        for (s1, e1), (s2, e2) in zip(found, found[1:]):
            if s2 > e1:
                continue
            root = x[s2:s2 + p]
            for turn in range(p):
                j = e1 - p - turn
                if j >= s1 and np.array_equal(x[j:j + p], root):
                    low = (s2 - j) + p * max(0, -(-(scale - (s2 - j)) // p))
                    for d in range(low, min(2 * scale, min(e1 - s1, e2 - s2) + p), p):
                        out.append((max(s1, s2 - d), d))
                    break
    return out


def find_runs(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The runs (start, length, period) of each text (arrays of word numbers, equal for equal words), by start, then period.

    A run is a stretch with smallest period q and a length of at least ``max(12, 2 q)`` that no neighbouring word extends.
    """
    texts = _Texts(ids)
    runs = texts.scan()
    # Texts in which some 16 words are met twice may hold longer periods; hashes decide only who is looked at.
    gram = _LAGS // 2
    again = []
    for i, part in enumerate(ids):
        again.append(len(part) >= 2 * _LAGS)
    if any(again):
        hashes = window_hashes(mix(texts.x.astype(np.uint64)), gram)
        owner = texts.owner[:len(hashes)]
        wanted = np.flatnonzero(np.array(again)[owner])
        order = wanted[np.lexsort((hashes[wanted], owner[wanted]))]
        twice = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        chosen = np.unique(owner[order[1:][twice]])
    else:
        chosen = np.zeros(0, np.int64)
    found = [runs]
    if len(chosen):
        some = _Texts([ids[i] for i in chosen])
        moved = np.full(len(ids), -1, np.int64)
        moved[chosen] = some.starts
        known = runs[moved[texts.owner[runs[:, 0]]] >= 0]
        shift = moved[texts.owner[known[:, 0]]] - texts.starts[texts.owner[known[:, 0]]]
        known = np.stack([known[:, 0] + shift, known[:, 1] + shift, known[:, 2]], 1)
        longer = _long_periods(some, known)
        back = texts.starts[chosen[some.owner[longer[:, 0]]]] - some.starts[some.owner[longer[:, 0]]]
        found.append(np.stack([longer[:, 0] + back, longer[:, 1] + back, longer[:, 2]], 1))
    runs = _distinct(found)
    owner = texts.owner[runs[:, 0]]
    local = np.stack([runs[:, 0] - texts.starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    local = local[np.lexsort((local[:, 2], local[:, 0], owner))]
    return np.split(local, np.cumsum(np.bincount(owner, minlength=len(ids)))[:-1]) if ids else []


def _long_periods(texts: _Texts, runs: np.ndarray) -> np.ndarray:
    """Runs of periods from ``_LAGS`` on, given all those of shorter ones."""
    names, longest = _Names(texts.x), int(texts.sizes.max())
    scale, new = _LAGS, []
    while 2 * scale <= longest:
        half = scale // 2
        grams = names.level(half.bit_length() - 1)
        inner = runs[(2 * runs[:, 2] <= half) & (runs[:, 1] - runs[:, 0] >= half)]
        depth = np.zeros(len(grams) + 1, np.int64)
        np.add.at(depth, inner[:, 0], 1)
        np.add.at(depth, inner[:, 1] - half + 1, -1)
        at = _samples(grams, (np.cumsum(depth[:-1]) == 0) & (grams >= 0), half + 1)
        order = at[np.lexsort((at, grams[at]))]
        seeds = [np.array(_touching(names, runs, scale), np.int64).reshape(-1, 2)]
        for step in range(1, len(order)):
            a, b = order[:-step], order[step:]
            near = (grams[a] == grams[b]) & (b - a < 2 * scale)
            if not near.any():
                break
            keep = near & (b - a >= scale) & (texts.owner[a] == texts.owner[b])
            seeds.append(np.stack([a[keep], (b - a)[keep]], 1))
        seeds = np.unique(np.concatenate(seeds), axis=0)
        if len(seeds):
            place, lag = seeds[:, 0], seeds[:, 1]
            first = place - names.behind(place, place + lag, longest)
            last = place + names.ahead(place, place + lag, longest)
            true = last - first >= lag
            fresh = np.stack([first[true], (last + lag)[true], lag[true]], 1)
            runs = _distinct([runs, fresh])
            new.append(fresh)
        scale *= 2
    return _distinct([runs, *new])


def _digest(runs: np.ndarray) -> str:
    return hashlib.sha256("".join("%d,%d,%d\n" % tuple(r) for r in runs.tolist()).encode()).hexdigest()


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    if not len(runs):
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
    return [w for w, n in zip(words, np.cumsum(inside)[:-1].tolist()) if not n]


def _read(tails: bool, collapse: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("__key").to_pylist(), batch.column("__text")
            out: list[tuple] = []
            held: list[list[bytes]] = []
            size = 0

            def flush():
                numbers: defaultdict[bytes, int] = defaultdict()
                numbers.default_factory = numbers.__len__  # the next number for a new word
                ids = [np.fromiter(map(numbers.__getitem__, x), np.int64, len(x)) for x in held]
                for words, runs in zip(held, find_runs(ids)):
                    kept = b" ".join(_kept(words, runs))
                    best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
                    out.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, _digest(runs),
                                hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if collapse else None))
                held.clear()

            for i in range(batch.num_rows):
                words = split_words(texts[i].as_py())
                held.append(repeat_tail(words, keys[i]) if tails else words)
                size += len(words)
                if size >= _CHUNK:
                    flush()
                    size = 0
            flush()
            names = [n for n in batch.schema.names if n not in ("__key", "__text")]
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            added = [*RESULTS, "collapsed_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns], [*names, *added])
    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", tails: bool = False, collapse: bool = False) -> DataFrame:
    """``docs`` without ``text``, plus ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli`` of the longest run (ties: smallest start,
    then period; null without a run); ``runs_sha256`` of all runs' lines; ``collapsed_sha256`` and, with ``collapse``, ``collapsed_text``: the
    words that lie in no run behind its first period, joined by one space.

    Words are parted by space and \\x09-\\x0D. ``tails`` makes some texts periodic first, by their key (null keys: none). Null and empty texts have
    no words and no run; repeated rows get equal results; an empty table stays empty; columns with the names of results are replaced. Each
    text is worked whole in one task, in memory proportional to its words times the logarithm of their number.
    """
    small_batches(docs.sparkSession)
    gone = (text, *RESULTS, "collapsed_text")
    held = [F.col(f"`{c}`") for c in docs.columns if c not in gone or c == key and key != text]
    rows = docs.select(*held, F.col(f"`{key}`").cast("long").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    out = docs.select(*held).schema
    for name in RESULTS:
        out = out.add(name, "string" if name.endswith("sha256") else "long")
    done = rows.mapInArrow(_read(tails, collapse), out.add("collapsed_text", "string"))
    return done if collapse else done.drop("collapsed_text")
