"""Byte-pair merging with a heap over a linked list, and caches of finished words inside a Python worker."""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np

#: Characters that the tokenizers' patterns call white space (a fixed value).
SPACE = r"\t-\r \x85\xa0  -     　"
#: How byte-level vocabularies split a text before merging (a fixed value, with the class above spelled out).
BYTE_PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: How the lower-case vocabulary with word ends splits (a fixed value).
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Rank of a pair that no rule merges.
NONE = 1 << 40
_AFTER, _BEFORE = list(range(1, 257)), list(range(-1, 255))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merge rules of a tokenizer file: ``first[b]`` and ``last[b]`` are the symbols of a byte inside and at a word's end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, ids = held["model"], held["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.first = [ids[c] for c in letters]
        self.last = [ids[c + end] for c in letters]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.rules: list[dict[int, int]] = [{} for _ in range(1 + max(ids.values()))]  # by left symbol: right symbol, rank
        self.made = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.rules[ids[left]].setdefault(ids[right], rank)
            self.made.append(ids[left + right])
        self.tokens = {i: t for t, i in [*ids.items(), *self.special.items()]}

    def symbols(self, word: bytes) -> list[int]:
        out = [self.first[b] for b in word]
        if out:
            out[-1] = self.last[word[-1]]
        return out

    def merge(self, symbols: list[int]) -> int:
        """Merges ``symbols`` in place (removed ones become -1) and returns how many merges were made.

        The heap holds ``rank, place``; an entry is stale when the pair at its place has another rank by now.
        """
        rules, made, n = self.rules, self.made, len(symbols)
        after, before = (_AFTER[:n], _BEFORE[:n]) if n <= 256 else (list(range(1, n + 1)), list(range(-1, n - 1)))
        shift = 8 if n <= 256 else 40
        mask = (1 << shift) - 1
        heap = [rank << shift | i for i, rank in enumerate([rules[a].get(b, -1) for a, b in zip(symbols, symbols[1:])]) if rank >= 0]
        heapify(heap)
        merges = 0
        while heap:
            entry = heappop(heap)
            i = entry & mask
            left, j = symbols[i], after[i]
            if left < 0 or j >= n:
                continue
            rank = entry >> shift
            if rules[left].get(symbols[j]) != rank:
                continue
            merges += 1
            symbols[i] = left = made[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = rules[left].get(symbols[k], -1)
                if rank >= 0:
                    heappush(heap, rank << shift | i)
            k = before[i]
            if k >= 0:
                rank = rules[symbols[k]].get(left, -1)
                if rank >= 0:
                    heappush(heap, rank << shift | k)
        return merges


    def ids(self, word: bytes) -> list[int]:
        """The ids of a word. Short words are merged by looking for the lowest rank in a list, long ones with the heap."""
        symbols, rules, none = self.symbols(word), self.rules, 1 << 30
        if len(symbols) > 32:
            self.merge(symbols)
            return [s for s in symbols if s >= 0]
        ranks = [rules[a].get(b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            symbols[i] = made = self.made[rank]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rules[symbols[i - 1]].get(made, none)
            if i < len(ranks):
                ranks[i] = rules[made].get(symbols[i + 1], none)
        return symbols


class ManyWords:
    """Merges many words at once: a round makes the merge of lowest rank (the leftmost of these) in every unfinished word."""

    def __init__(self, rules: Vocabulary):
        pairs = np.array([(left << 32 | right, rank) for left, held in enumerate(rules.rules) for right, rank in held.items()], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.keys, self.ranks = np.r_[pairs[:, 0], np.int64(1) << 62], np.r_[pairs[:, 1], NONE]
        self.made, self.first, self.last = (np.array(x, np.int64) for x in (rules.made, rules.first, rules.last))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the (non-empty) words in a row, and where each word ends."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols, word = self.first[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        ranks = np.full(len(symbols), NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        done = []
        while len(word):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[starts, len(word)])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), count)
            going = lowest < NONE
            done.append((word[~going], symbols[~going]))
            word, symbols, ranks, lowest = word[going], symbols[going], ranks[going], lowest[going]
            at = np.flatnonzero(ranks == lowest)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]] if len(at) else at
            symbols[at] = self.made[ranks[at]]
            kept = np.ones(len(word), bool)
            kept[at + 1] = False
            word, symbols, ranks = word[kept], symbols[kept], ranks[kept]
            at = at - np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                ranks[left] = NONE
                left = left[left + 1 < len(word)]
                left = left[word[left] == word[left + 1]]
                ranks[left] = self.rank(symbols[left], symbols[left + 1])
        word, symbols = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return symbols[np.argsort(word, kind="stable")], np.cumsum(np.bincount(word, minlength=len(words)))


class Recent(dict):
    """Finished words by text: misses are computed; when full the older half of what was not asked for again goes."""

    def __init__(self, compute, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.older = compute, limit, longest, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


def segments(text: str, special: dict[str, int]):
    """Ordinary stretches (str) and ids (int) of special strings in the order of a text."""
    parts: list = [text]
    for name, number in special.items():
        parts = [x for part in parts for x in (_between(part, name, number) if isinstance(part, str) and name in part else (part,))]
    return parts


def _between(text: str, name: str, number: int) -> list:
    out: list = []
    for piece in text.split(name):
        out += [piece, number]
    return out[:-1]
