"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary.

The filters are split by word length and blocked: a word sets four bits of one 64-bit block. Probes are computed from position-wise
hashes of characters, so an edit costs a few array operations and no string. Only probes that a filter lets through become rows; a
join with the vocabulary keeps the true ones. A filter is broadcast, so its size is bounded: beyond ``max_bytes`` the vocabulary is cut
into slices by hash, and each slice is built, broadcast and probed on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.decontamination import ascii_lower
from corpusmill.llm.words import discard, mix, stored
from corpusmill.session import compute_once

_GAP = r"[^A-Za-zÀ-ÿ]+"
_ROWS = 2048  # words of one length probed at a time


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", alter: Callable[[Column, Column], Column] | None = None,
                min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n) of the lower-cased letter runs of all whole texts; ``alter`` may change a run, given the row's key and the run."""
    body = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    each = body.select("key", F.explode(F.split(ascii_lower(F.col("text")), _GAP)).alias("word")).where(F.char_length("word") >= min_length)
    if alter is not None:
        each = compute_once(each, {"word": alter(F.col("key"), F.col("word"))}).where(F.char_length("word") >= min_length)
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def drop_a_letter(key: Column, word: Column, rate: int = 31) -> Column:
    """The word without one letter where ``rate`` divides crc32 of ``<key>:<word>``; the letter's place is crc32 modulo length."""
    h = F.crc32(F.concat(key, F.lit(":"), word))
    at = F.pmod(h, F.char_length(word)).cast("int")
    return F.when(h % rate == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points as one matrix) of the words of each length, in blocks."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        for i in range(0, len(mine), _ROWS):
            at = mine[i:i + _ROWS]
            raw = "".join([words[j] for j in at]).encode("utf-32-le", "surrogatepass")
            yield at, np.frombuffer(raw, "<u4").astype(np.uint64).reshape(len(at), int(size))


def _at(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of each character at its place; the hash of a word is the exclusive or of them."""
    return mix((codes + np.uint64(1)) ^ (places.astype(np.uint64) + np.uint64(1)) << np.uint64(32))


def _mask(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(h.shape, np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= np.uint64(1) << (h >> np.uint64(shift) & np.uint64(63))
    return bits


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    return (h >> np.uint64(24) & np.uint64(255)) % np.uint64(slices)


def _bits(layout: dict[int, tuple[int, int]], slices: int, number: int):
    """(block, bits) of the words of one slice, merged within a task's batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, masks = [], []
            for _, codes in _by_length(batch.column("word").to_pylist()):
                first, count = layout[codes.shape[1]]
                h = mix(np.bitwise_xor.reduce(_at(codes, np.arange(codes.shape[1])), axis=1))
                h = h[_slice(h, slices) == number]
                blocks.append(first + _block(h, count))
                masks.append(_mask(h).view(np.int64))
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks)), pa.array(np.concatenate(masks))], ["block", "mask"])
    return run


def _probes(shared, layout: dict[int, tuple[int, int]], letters: list[int], slices: int, number: int):
    """(word, n, near) for the edits of each word that the filter of their length lets through.

    Of two words of one length the one with the smaller character probes, of two lengths the longer one: each pair comes once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, alphabet = shared.value, np.array(letters, np.uint64)

        def passed(h, first, count):
            h = mix(h)
            here = np.flatnonzero(_slice(h, slices) == number) if slices > 1 else np.arange(len(h))
            h = h[here]
            held = table[first + _block(h, count)]
            some = np.flatnonzero(held >> (h & np.uint64(63)) & np.uint64(1))  # one bit rejects most
            mask = _mask(h[some])
            return here[some[held[some] & mask == mask]]

        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            source, near = [], []
            for at, codes in _by_length(words):
                rows, size = codes.shape
                places = np.arange(size)
                here, before = _at(codes, places), _at(codes, places - 1)
                whole = np.bitwise_xor.reduce(here, axis=1)
                for i in range(size):
                    if size in layout:
                        other = alphabet[None, :] > codes[:, i, None]
                        row, letter = np.nonzero(other)
                        h = (whole ^ here[:, i])[row] ^ _at(alphabet, np.full(1, i))[letter]
                        for j in passed(h, *layout[size]).tolist():
                            w = words[at[row[j]]]
                            source.append(at[row[j]])
                            near.append(w[:i] + chr(letters[letter[j]]) + w[i + 1:])
                    if size - 1 in layout:
                        # Of equal neighbours only the last is taken out: the others give the same word.
                        row = np.flatnonzero(codes[:, i] != codes[:, i + 1]) if i + 1 < size else np.arange(rows)
                        h = np.bitwise_xor.reduce(here[row, :i], axis=1) ^ np.bitwise_xor.reduce(before[row, i + 1:], axis=1)
                        for j in passed(h, *layout[size - 1]).tolist():
                            w = words[at[row[j]]]
                            source.append(at[row[j]])
                            near.append(w[:i] + w[i + 1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[j] for j in source], pa.string()), pa.array([n[j] for j in source], pa.int64()), pa.array(near, pa.string())],
                ["word", "n", "near"])
    return run


def near_words(words: DataFrame, bits_per_word: int = 24, max_bytes: int = 64 << 20, per_task: int = 10_000) -> DataFrame:
    """(a, na, b, nb): pairs of words in ``(word, n)`` that differ by one inserted, deleted or replaced character, each pair once.

    Edits use the characters that occur in the words, so no pair is missed. ``words`` must be distinct and stored.
    """
    spark = words.sparkSession
    counts = {r["size"]: r["n"] for r in words.groupBy(F.char_length("word").alias("size")).agg(F.count("*").alias("n")).collect()}
    letters = sorted(ord(r["c"]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect())
    total = sum(counts.values())
    slices = max(1, -(-total * bits_per_word // (8 * max_bytes)))
    if slices > 256:
        raise ValueError(f"{total} words need more than 256 filters of {max_bytes} bytes: raise max_bytes")
    layout, first = {}, 0
    for size, n in sorted(counts.items()):
        layout[size] = (first, max(1, -(-n * bits_per_word // (64 * slices))))
        first += layout[size][1]
    dealt = words.select("word", "n").repartition(max(1, -(-total // per_task)), "word")
    found = None
    for number in range(slices):
        rows = words.select("word").mapInArrow(_bits(layout, slices, number), "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toPandas()
        table = np.zeros(max(first, 1), np.uint64)
        table[rows["block"].to_numpy()] = rows["mask"].to_numpy().astype(np.int64).view(np.uint64)
        shared = spark.sparkContext.broadcast(table)
        hits = dealt.mapInArrow(_probes(shared, layout, letters, slices, number), "word string, n long, near string")
        hits = stored(hits, "probes")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "word string, n long, near string")
    exact = words.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    return found.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("near").alias("b")).join(exact, "b").select("a", "na", "b", "nb")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words in ``(word, form)``: steps of 1, 2, 4, ... forms until none goes on."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(roots)
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


def group_variants(words: DataFrame, ratio: int = 10, bits_per_word: int = 24, max_bytes: int = 64 << 20) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word string, n long).

    ``n_near`` counts the other words one edit away; ``form`` is the one of largest n (ties: smallest in code-point order) if its n is at least
    ``ratio`` (over 1) times the word's, else null; ``root`` ends the chain of forms and is the word itself without one. Null words are
    left out, repeated words count with the sum of their n; other columns are ignored, an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: forms must grow along a chain")
    table = stored(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    pairs = near_words(table, bits_per_word, max_bytes)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    rated = table.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(
        -F.col("best.n") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.n")).alias("n"))).alias("f"))
    rated = stored(rated.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")), "variants")
    roots = _roots(rated.where("form IS NOT NULL"))
    return rated.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
