"""Packing of token pieces into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.words import process_cache, small_batches, stored


def difference(sizes: Sequence[int], windows: int) -> list[list[int]]:
    """Items by window. A partial partition is ``windows`` sums in falling order, less their smallest; the two with the largest
    spreads merge with opposing orders until one is left. Members of a sum are a linked list, so a merge is a few array steps."""
    n = len(sizes)
    after = np.full(n, -1)
    heap = []
    for i, size in enumerate(sizes):
        sums, head, tail = np.zeros(windows, np.int64), np.full(windows, -1), np.full(windows, -1)
        sums[0], head[0], tail[0] = size, i, i
        heap.append((-size, i, sums, head, tail))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sums, head, tail = heapq.heappop(heap)
        _, _, sums2, head2, tail2 = heapq.heappop(heap)
        sums2, head2, tail2 = sums2[::-1], head2[::-1], tail2[::-1]
        both = (tail >= 0) & (head2 >= 0)
        after[tail[both]] = head2[both]
        total = sums + sums2
        head, tail = np.where(head >= 0, head, head2), np.where(tail2 >= 0, tail2, tail)
        order = np.argsort(-total, kind="stable")
        total = total[order]
        spread = int(total[0] - total[-1])
        heapq.heappush(heap, (-spread, serial, total - total[-1], head[order], tail[order]))
        serial += 1
    out = []
    for i in heap[0][3].tolist() if heap else ():
        row = []
        while i >= 0:
            row.append(i)
            i = int(after[i])
        out.append(row)
    return out


def windows_for(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``: their count rises as long as any is over it, faster the more it is over."""
    count = -(-sum(sizes) // capacity)
    while count:
        found = difference(sizes, count)
        over = max(sum(sizes[i] for i in row) for row in found) - capacity
        if over <= 0:
            return [row for row in found if row]
        count += max(1, count * over // (3 * capacity))
    return []


def cuts(tokens: int, capacity: int, small: int) -> list[tuple[int, int]]:
    """``(start, length)`` pieces of a document: full windows, then the rest, on wish with a ``small`` piece at its end to balance sums."""
    out = [(s, capacity) for s in range(0, tokens - capacity + 1, capacity)]
    start = len(out) * capacity
    rest = tokens - start
    if small and rest > 2 * small:
        out.append((start, rest - small))
        start, rest = tokens - small, small
    if rest:
        out.append((start, rest))
    return out


class _Tokens:
    """Ids of a byte-level vocabulary from its rank file; texts that this engine refuses go to the tokenizers library."""

    def __init__(self, ranks: str, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.exact = Tokenizer.from_file(vocabulary)
        special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items() if t.special}
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except (ValueError, RuntimeError):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def _pieces(ranks: str, vocabulary: str, capacity: int, small: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = process_cache(f"packing {ranks}", lambda: _Tokens(ranks, vocabulary))
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            for row, text in zip(batch.column("__row").to_pylist(), batch.column("__text").to_pylist()):
                ids = np.append(tokens.ids(text), np.uint32(end))
                for start, length in cuts(len(ids), capacity, small):
                    rows.append((row, start, length, len(ids), ids[start:start + length].tobytes(), serial))
                    serial += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            names = ["__row", "start", "length", "doc_tokens", "ids", "__serial"]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
    return run


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__serial").reset_index(drop=True)
        sizes, ids = group["length"].tolist(), group["ids"].tolist()
        sequence, offset, crc = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for number, row in enumerate(windows_for(sizes, capacity)):
            window = b"".join(ids[i] for i in row)
            at = 0
            for i in row:
                sequence[i], offset[i] = number, at
                crc[i] = zlib.crc32(window[4 * at:4 * (at + sizes[i])])
                at += sizes[i]
        group["ids_crc32"], group["sequence_id"], group["offset"] = crc, group["__group"].to_numpy() * (1 << 32) + sequence, offset
        return group.drop(columns=["__group", "__serial"])
    return run


def pack(docs: DataFrame, ranks: str, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, small: int = 32,
         end: int = 0, per_group: int = 300) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` (binary, little-endian 32 bits).

    A document's ids are those of its text (null: empty) and ``end``. Full windows are sequences of their own and never grouped; the rest is
    dealt evenly over groups of about ``per_group`` pieces, by the number of such pieces at every input size, and each group is packed, ids
    included, by differencing. Pieces are dealt by their serial number, so copies, repeated rows and null keys spread as well. An empty table gives no piece.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("__row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    kinds = "__row long, start long, length long, doc_tokens long, ids binary, __serial long"
    pieces = stored(rows.mapInArrow(_pieces(ranks, vocabulary, capacity, small, end), kinds), "pieces")
    rest = pieces.where(f"length < {capacity}")
    groups = max(1, rest.count() // per_group)
    out = "__row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    packed = rest.withColumn("__group", F.pmod(F.xxhash64("__serial"), F.lit(groups)).cast("long")).groupBy("__group").applyInPandas(_pack(capacity), out)
    full = pieces.where(f"length = {capacity}").select(
        "__row", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", (F.lit(1 << 62) + F.col("__serial")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "ids")
    return packed.unionByName(full).withColumnRenamed("__row", key)
