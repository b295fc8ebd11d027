"""Token counts of whole texts by heap-and-linked-list byte-pair merging; no token ids are made."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.bpe import BYTE_PATTERN, SPACE, Recent, Vocabulary, segments
from corpusmill.llm.words import process_cache, small_batches


class _Counter:
    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(BYTE_PATTERN).findall
        self.words = Recent(self.word, 150_000)
        self.spaced = Recent(self.chunk)
        self.run = re.compile(rf"[{SPACE}][{SPACE}]").search

    def word(self, word: str) -> int:
        symbols = self.vocabulary.symbols(word.encode("utf-8", "surrogatepass"))
        return len(symbols) - self.vocabulary.merge(symbols)

    def chunk(self, chunk: str) -> int:
        """Tokens of a space and the chunk after it."""
        if chunk.isalpha():
            return self.word(" " + chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ",.":
            return self.spaced[chunk[:-1]] + 1
        return sum(map(self.words.__getitem__, self.split(" " + chunk)))

    def text(self, text: str) -> int:
        return sum(1 if isinstance(part, int) else self.plain(part) for part in segments(text, self.vocabulary.special))

    def plain(self, text: str) -> int:
        """Without two white-space characters in a row no token crosses the start of a space, so chunks count by themselves."""
        if self.run(text):
            return sum(map(self.words.__getitem__, self.split(text)))
        first, *others = text.split(" ")
        return sum(map(self.words.__getitem__, self.split(first))) + sum(map(self.spaced.__getitem__, others))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = process_cache(f"token_counter {path}", lambda: _Counter(path))
        for batch in batches:
            numbers = [counter.text(t) for t in batch.column("__text").to_pylist()]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(numbers, pa.int64())], [*names, "n_tokens"])
    return run


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` without ``text``, plus ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is a byte-level tokenizer file that every executor has. A null text counts as empty: 0 bytes, 0 tokens.
    A special string in a text is one token. No row is dropped, repeated rows and null keys stay; columns with the names of
    results are replaced. A projection: no shuffle, and words are counted once per worker while its cache holds them.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*others, F.octet_length(body).cast("long").alias("n_bytes"), body.alias("__text"))
    out = rows.drop("__text").schema.add("n_tokens", "long")
    return rows.mapInArrow(_count(vocabulary), out).withColumn("over_limit", F.col("n_tokens") > limit)
