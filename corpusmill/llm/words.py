"""Words and word-window hashes of whole texts, as numpy arrays inside a task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
import xxhash

from corpusmill.session import discard, scratch_path, shuffles_removed, small_batches, stored  # noqa: F401

_STEP = np.uint64(0x9E3779B97F4A7C15)


def process_cache(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks; functions shipped by value would otherwise start anew each time."""
    kept = sys.modules.setdefault("corpusmill_process_cache", types.ModuleType("corpusmill_process_cache"))
    if name not in kept.__dict__:
        setattr(kept, name, make())
    return kept.__dict__[name]


def process_latest(name: str, key: str, make: Callable[[], object]) -> object:
    """Like ``process_cache``, but only the value of the last ``key`` stays: a worker that serves many jobs holds one of them."""
    held = process_cache(name, dict)
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of characters other than space and \\x09-\\x0D, in UTF-8; ``lower`` changes A-Z alone. None has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One value for each run of ``width`` consecutive words, equal for equal runs."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total *= _STEP
        total += hashes[j:n + j]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
