"""BPE encoding and decoding with a minimal acyclic transducer of frequent words; other words are merged exactly.

The most frequent letter runs of the corpus are encoded once and compiled into an automaton that shares prefixes and
suffixes. Numbers on its arcs add up to the place of a word in the sorted lexicon, which leads to its ids. The automaton is one
block of bytes, sent to the executors once and memory-mapped there.
"""

from __future__ import annotations

import gc
import hashlib
import mmap
import struct
import tempfile
import unicodedata
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.bpe import WORD_PATTERN, ManyWords, Vocabulary, segments
from corpusmill.llm.words import process_latest, small_batches

#: Finished chunks that a worker keeps, words among them (as many older ones, and those of one group more).
CHUNKS = 250_000
#: Characters of the texts that are coded together, and bytes above which a word is merged by itself.
GROUP, LONG = 1_000_000, 64


_BYTES = [bytes([b]) for b in range(256)]


def compile_lexicon(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The transducer of sorted distinct words: states are registered from the end of each word, so equal suffixes are shared."""
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    register: dict[tuple, int] = {}
    path: list[list] = [[False, []]]  # of the last word: [final, arcs]; the last arc of each but the deepest is open

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            label, _ = path[-1][1][-1]
            path[-1][1][-1] = (label, register[key])

    last = b""
    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(shared)
        for label in word[shared:]:
            path[-1][1].append((label, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    root = (path[0][0], tuple(path[0][1]))
    states.append(root)
    below, first, labels, targets, outputs = [], [0], bytearray(), [], []
    for final, arcs in states:  # targets come before their sources
        passed = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            outputs.append(passed)
            passed += below[target]
        below.append(passed)
        first.append(len(labels))
    offsets = np.cumsum([0, *map(len, ids)])
    flat = [i for x in ids for i in x]
    finals = bytes(int(final) for final, _ in states)
    head = np.array([len(states), len(labels), len(words), len(flat)], "<i4").tobytes()
    numbers = b"".join(np.array(x, "<i4").tobytes() for x in (first, targets, outputs, offsets, flat))
    return head + numbers + finals + bytes(labels)


class Lexicon:
    """A compiled lexicon, mapped from an unnamed file of the executor."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.memory = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n_states, n_arcs, n_words, n_ids = np.frombuffer(self.memory, "<i4", 4).tolist()
        at, views = 16, []
        for size in (n_states + 1, n_arcs, n_arcs, n_words + 1, n_ids):
            views.append(memoryview(self.memory)[at:at + 4 * size].cast("i"))
            at += 4 * size
        self.first, self.targets, self.outputs, self.offsets, self.ids = views
        self.finals, self.labels, self.root = at, at + n_states, n_states - 1
        first, *self.arrays = (np.array(v, np.int64) for v in views)
        labels = np.frombuffer(self.memory, np.uint8, n_arcs, self.labels)
        # The labels of a state's arcs ascend, so these keys do.
        self.keys = np.r_[np.repeat(np.arange(n_states) << 8, np.diff(first)) | labels, np.int64(1) << 62]
        self.ends_word = np.frombuffer(self.memory, np.uint8, n_states, self.finals) != 0

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word, None if the lexicon lacks it."""
        state, place, find, base = self.root, 0, self.memory.find, self.labels
        first, outputs, targets = self.first, self.outputs, self.targets
        for byte in word:
            arc = find(_BYTES[byte], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            place += outputs[arc]
            state = targets[arc]
        if not self.memory[self.finals + state]:
            return None
        return self.ids[self.offsets[place]:self.offsets[place + 1]].tolist()


    def find_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words the lexicon has, all ids of those in a row, and where each of them ends: the words walk side by side, a byte a step."""
        targets, outputs, offsets, flat = self.arrays
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw, start = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(sizes) - sizes
        state, place, going, known = np.full(len(words), self.root), np.zeros(len(words), np.int64), np.arange(len(words)), np.zeros(len(words), bool)
        for depth in range(int(sizes.max(initial=0)) + 1):
            done = sizes[going] == depth
            known[going[done]] = self.ends_word[state[going[done]]]
            going = going[~done]
            key = state[going] << 8 | raw[start[going] + depth]
            arc = np.searchsorted(self.keys, key)
            there = self.keys[arc] == key
            going, arc = going[there], arc[there]
            place[going] += outputs[arc]
            state[going] = targets[arc]
            if not len(going):
                break
        at = place[known]
        count = offsets[at + 1] - offsets[at]
        ends = np.cumsum(count)
        return known, flat[np.repeat(offsets[at] - ends + count, count) + np.arange(count.sum())], ends


def normal(text: str) -> str:
    """NFC and lower case, character by character (a final sigma is an ordinary one)."""
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Python looks for no cycles inside: a group makes none, but very many small objects, each few of which start a search."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


class _Codec:
    """Codes texts group by group: the new chunks of a group are split into words, and its new words are coded together."""

    def __init__(self, path: str, block: bytes):
        import regex

        self.vocabulary, self.lexicon = Vocabulary(path), Lexicon(block)
        self.many = ManyWords(self.vocabulary)
        self.split = regex.compile(WORD_PATTERN).findall
        self.chunks = Known(CHUNKS)

    @staticmethod
    def joined(found: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])

    def packed(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.vocabulary.tokens[i] for i in ids])

    def keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        held, name, start = self.chunks.held, self.vocabulary.tokens.__getitem__, 0
        block, tokens = ids.astype("<u4").tobytes(), list(map(name, ids.tolist()))
        for word, end in zip(words, ends.tolist()):
            held[word] = block[4 * start:4 * end], " ".join(tokens[start:end])
            start = end

    def learn(self, words: list[str]) -> None:
        """Codes new words: those of the lexicon by a walk through it, long ones one by one, the others merged together."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        known, ids, ends = self.lexicon.find_all(raws)
        self.keep([words[i] for i in np.flatnonzero(known).tolist()], ids, ends)
        rest = []
        for i in np.flatnonzero(~known).tolist():
            if len(raws[i]) > LONG:
                self.chunks.held[words[i]] = self.packed(self.vocabulary.ids(raws[i]))
            else:
                rest.append(i)
        if rest:
            self.keep([words[i] for i in rest], *self.many.ids([raws[i] for i in rest]))

    def pieces(self, text: str) -> list[str | int]:
        """Chunks between white space in normal form, and the ids of special strings."""
        out: list[str | int] = []
        for part in segments(text, self.vocabulary.special):
            if isinstance(part, int):
                out.append(part)
                continue
            part = part.lower() if part.isascii() else normal(part)
            if "\x1c" in part or "\x1d" in part or "\x1e" in part or "\x1f" in part:  # str.split() takes these for white space, the tokenizer does not
                out.append(part)
            else:  # white space always separates, so its chunks are coded by themselves
                out += part.split()
        return out

    def group(self, texts: list[str]) -> list[tuple[bytes, str]]:
        with _no_cycles():
            cut = [self.pieces(t) for t in texts]
            new, words, marked, others, held = self.chunks.missing(set().union(*cut)), set(), [], [], self.chunks.held
            for c in new:
                if isinstance(c, int):
                    held[c] = self.packed([c])
                elif c.isalpha():  # a word, and coded alike as a part of other chunks
                    words.add(c)
                elif c[-1:] in (",", ".") and c[:-1].isalpha():
                    marked.append((c, c[:-1], c[-1]))
                else:
                    others.append((c, self.split(c)))
            inner = {w for _, found in others for w in found}
            for _, word, mark in marked:
                inner.add(word)
                inner.add(mark)
            words.update(self.chunks.missing(inner - words))
            self.learn(list(words))
            for c, word, mark in marked:
                (ids, tokens), (last, point) = held[word], held[mark]
                held[c] = ids + last, f"{tokens} {point}"
            for c, found in others:
                held[c] = self.joined([held[w] for w in found])
            out = [self.joined([held[c] for c in one]) for one in cut]
            self.chunks.trim([*new, *words])
            return out

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= GROUP:
                yield from self.group(texts[start:i + 1])
                start, size = i + 1, 0
        yield from self.group(texts[start:])


class Known:
    """Finished pieces; when more than ``limit`` are held, the ones that were not asked for since the last time go."""

    def __init__(self, limit: int, longest: int = 64):
        self.limit, self.longest, self.held, self.older = limit, longest, {}, {}

    def missing(self, wanted: set) -> list:
        """The wanted ones that have to be made; all others are in ``held`` then."""
        out, held, older = [], self.held, self.older
        for x in wanted.difference(held):
            if x in older:
                held[x] = older[x]
            else:
                out.append(x)
        return out

    def trim(self, made) -> None:
        """Lets long ones of those just made go, and the older half when full."""
        for x in [x for x in made if isinstance(x, str) and len(x) > self.longest]:
            self.held.pop(x, None)
        if len(self.held) >= self.limit:
            self.older, self.held = self.held, {}


def _encode(path: str, block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = process_latest("word codec", f"{path} {hashlib.sha256(block.value).hexdigest()}", lambda: _Codec(path, block.value))
        for batch in batches:
            coded = list(codec.texts(batch.column("__text").to_pylist()))
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array([len(i) // 4 for i, _ in coded], pa.int64()),
                                                    pa.array([i for i, _ in coded], pa.binary()), pa.array([t for _, t in coded], pa.string())],
                [*names, "n_tokens", "ids", "decoded"])
    return run


def frequent_words(docs: DataFrame, text: str = "text", size: int = 50_000, longest: int = 40) -> list[str]:
    """The ``size`` most frequent lower-case letter runs of all rows, of at most ``longest`` letters; ties by word."""
    words = docs.select(F.explode(F.split(F.lower(f"`{text}`"), r"[^\p{L}]+")).alias("word")).where(f"word <> '' AND length(word) <= {longest}")
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in top.collect()]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", size: int = 50_000) -> DataFrame:
    """``docs`` without ``text``, plus ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    The lexicon is bounded by ``size`` words whatever the input, and only speeds words up: results do not depend on it. A null text
    counts as empty: no ids, empty decoded text. No row is dropped; null keys and repeated rows stay; columns with the names
    of results are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rules = Vocabulary(vocabulary)
    words = sorted({normal(w).encode("utf-8", "surrogatepass") for w in frequent_words(docs, text, size)})
    block = spark.sparkContext.broadcast(compile_lexicon(words, [rules.ids(w) for w in words]))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_tokens", "ids", "decoded")]
    rows = docs.select(*others, body.alias("__text"))
    out = rows.drop("__text").schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "string")
    return rows.mapInArrow(_encode(vocabulary, block), out)
