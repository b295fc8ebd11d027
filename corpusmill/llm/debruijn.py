"""Substring dedup: repeated word windows as compacted paths of a De Bruijn graph, verified at their source places.

A window of ``width`` words is an edge between its first and its last ``width - 1`` words. Only windows that can repeat
become edge rows: each window names its anchor (the run of ``anchor`` words in it with the smallest hash), equal windows
have equal anchors, and anchors seen at one place only drop out first. Edges met twice stay. An edge joins the
next one of its text when all places of the first go on alike and all places of the second come from alike: the
nonbranching path. Paths are spans ``(start, length)`` in their texts; a SHA-256 of the span's words proves that two places
agree, so no hash collision removes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.words import mix, signed, small_batches, split_words, stored, window_hashes, word_hashes

_KEYS = ["__k1", "__k2"]


def _anchors(width: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            k1, k2 = batch.column("__k1").to_numpy(), batch.column("__k2").to_numpy()
            for i, text in enumerate(batch.column("__text").to_pylist()):
                words = split_words(text)
                n = len(words) - width + 1
                if n < 1:
                    continue
                grams = window_hashes(word_hashes(words), anchor)
                inside = np.lib.stride_tricks.sliding_window_view(grams, width - anchor + 1)
                at = np.arange(n) + inside.argmin(axis=1)
                start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                value = grams[at[start]]
                _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
                m = len(start)
                parts.append((signed(value), np.full(m, k1[i]), np.full(m, k2[i]), start.astype(np.int32),
                              np.diff(np.r_[start, n]).astype(np.int32), (count[inverse] > 1).astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*parts)], ["anchor", "__k1", "__k2", "start", "n", "again"])
    return run


def _edges(width: int):
    """Windows under repeated anchors, once for each run of equal texts in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            parts = []
            k1, k2 = batch.column("__k1").to_numpy(), batch.column("__k2").to_numpy()
            texts, ranges = batch.column("__text"), batch.column("__ranges")
            for i in range(batch.num_rows):
                key = (k1[i], k2[i])
                if key == last:
                    continue
                last = key
                hashes = word_hashes(split_words(texts[i].as_py()))
                here = window_hashes(hashes, width)
                marked = np.zeros(len(here) + 1, np.int32)
                for r in ranges[i].as_py():
                    marked[r["start"]] += 1
                    marked[r["start"] + r["n"]] -= 1
                at = np.flatnonzero(np.cumsum(marked[:-1]) > 0)
                edge_of_text = np.r_[np.uint64(0), hashes, np.uint64(1)]
                m = len(at)
                parts.append((signed(here[at]), np.full(m, k1[i]), np.full(m, k2[i]), at.astype(np.int32),
                              signed(edge_of_text[at]), signed(edge_of_text[at + width + 1])))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*parts)], ["edge", "__k1", "__k2", "at", "before", "after"])
    return run


def _paths(width: int):
    """Compacted paths of a text with the digest of their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows: list[tuple] = []
            k1, k2 = batch.column("__k1").to_numpy(), batch.column("__k2").to_numpy()
            texts, places = batch.column("__text"), batch.column("__places")
            for i in range(batch.num_rows):
                key = (k1[i], k2[i])
                if key == last:
                    continue
                last = key
                words = split_words(texts[i].as_py())
                found = places[i].values if hasattr(places[i], "values") else pa.array([])
                at, edge = found.field("at").to_numpy(), found.field("edge").to_numpy()
                out, into = found.field("one_after").to_numpy(zero_copy_only=False), found.field("one_before").to_numpy(zero_copy_only=False)
                _, order = np.unique(at, return_index=True)  # a text that two tasks held has its places twice
                at, edge, out, into = at[order], edge[order], out[order], into[order]
                joined = (at[1:] == at[:-1] + 1) & out[:-1] & into[1:]
                first = np.flatnonzero(np.r_[True, ~joined])
                stop = np.r_[first[1:], len(at)]
                for a, b in zip(first.tolist(), stop.tolist()):
                    begin, size = int(at[a]), b - a + width - 1
                    digest = hashlib.sha256(b" ".join(words[begin:begin + size])).digest()
                    rows.append((int(edge[a]), digest, key[0], key[1], begin, size))
            if rows:
                names = ["path", "digest", "__k1", "__k2", "start", "size"]
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    return run


def _cut(width: int, verbatim: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_text = [], [], []
            spans, copies, texts = batch.column("__spans"), batch.column("__copies"), batch.column("__text")
            for i in range(batch.num_rows):
                words = split_words(texts[i].as_py())
                keep = np.ones(len(words), bool)
                if (copies[i].as_py() or 1) > 1 and len(words) >= width:
                    keep[:] = False
                else:
                    for s in spans[i].as_py() or ():
                        keep[s["start"]:s["start"] + s["size"]] = False
                left = int(keep.sum())
                n_words.append(len(words))
                n_removed.append(len(words) - left)
                if verbatim and left == len(words):
                    kept_text.append(texts[i].as_py())
                    continue
                kept = words if left == len(words) else [w for w, k in zip(words, keep.tolist()) if k]
                kept_text.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            names = [n for n in batch.schema.names if n not in ("__k1", "__k2", "__spans", "__copies", "__text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.string())],
                names + ["n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, text: str = "text", width: int = 35, anchor: int = 16, verbatim: bool = False) -> DataFrame:
    """``docs`` without ``text``, plus ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space;
    with ``verbatim`` a text that loses nothing stays as it is).

    A word goes when a window of ``width`` words over it starts at another place too, in any row, its own included; all
    places lose it. Null and empty texts have no words; texts shorter than a window keep all. Rows are never dropped: copies
    of a row, null keys and empty tables come back as they are. Columns named n_words, n_removed or kept_text are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_words", "n_removed", "kept_text")]
    dealt = docs.select(*others, body.alias("__text"), F.xxhash64(body).alias("__k1"), F.xxhash64(F.lit(1), body).alias("__k2"))
    keyed = dealt.select("__k1", "__k2", "__text")
    anchors = stored(keyed.mapInArrow(_anchors(width, anchor), "anchor long, __k1 long, __k2 long, start int, n int, again int"), "anchors")
    shared = (anchors.groupBy("anchor").agg(F.min("__k1").alias("low"), F.max("__k1").alias("high"), F.max("again").alias("again"))
              .where("low < high OR again = 1").select("anchor"))
    ranges = anchors.join(shared, "anchor", "left_semi").groupBy(*_KEYS).agg(F.collect_set(F.struct("start", "n")).alias("__ranges"))
    ranges = stored(ranges, "ranges")
    wanted = dealt.join(ranges, _KEYS).mapInArrow(_edges(width), "edge long, __k1 long, __k2 long, at int, before long, after long")
    edges = (wanted.groupBy("edge").agg(
        F.count("*").alias("met"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1"))
        .where("met > 1").select("edge", F.expr("b0 = b1 AND b0 <> 0").alias("one_before"), F.expr("a0 = a1 AND a0 <> 1").alias("one_after")))
    places = (wanted.select("edge", "__k1", "__k2", "at").join(edges, "edge").groupBy(*_KEYS)
              .agg(F.collect_list(F.struct("at", "edge", "one_after", "one_before")).alias("__places")))
    paths = stored(dealt.join(places, _KEYS).mapInArrow(
        _paths(width), "path long, digest binary, __k1 long, __k2 long, start int, size int"), "paths")
    proven = paths.groupBy("path", "digest").agg(F.count("*").alias("met")).where("met > 1").select("path", "digest")
    spans = (paths.join(proven, ["path", "digest"], "left_semi").groupBy(*_KEYS)
             .agg(F.collect_set(F.struct("start", "size")).alias("__spans")))
    copies = docs.select(F.xxhash64(body).alias("__k1"), F.xxhash64(F.lit(1), body).alias("__k2")).groupBy(*_KEYS).agg(
        F.count("*").alias("__copies")).where("__copies > 1")
    marks = copies.join(spans, _KEYS, "full")
    out = dealt.select(*[c for c in others]).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return dealt.join(marks, _KEYS, "left").mapInArrow(_cut(width, verbatim), out)
