"""A corpus pipeline of four operators: quality rules, near duplicates, repeated passages, packing."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from corpusmill.llm.debruijn import remove_repeats  # noqa: E402
from corpusmill.llm.packing import pack  # noqa: E402
from corpusmill.llm.partenum import near_classes  # noqa: E402
from corpusmill.llm.quality_llr import quality_rules  # noqa: E402
from corpusmill.llm.queries import trusted  # noqa: E402
from corpusmill.llm.words import stored  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep; the trusted side comes from the labels in ``sf_dir``."""
    return quality_rules(docs, trusted(spark, sf_dir)).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies (five words, similarity 0.8); documents without words all stay.

    Of rows that are alike in doc_id and text one stays; a row with a null doc_id stays only where its group has no other.
    """
    key = F.xxhash64(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = near_classes(docs, n=5, num=80, den=100).where("component IS NOT NULL")
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__text_key")).alias("best"))
    stays = best.select(F.xxhash64("best.__id", "best.__text_key").alias("__row")).distinct()
    rows = docs.withColumn("__row", key)
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = rows.where(~wordless).join(stays, "__row", "left_semi").dropDuplicates(["__row"])
    return kept.unionByName(rows.where(wordless)).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 35-word windows that occur twice; texts that lose nothing stay verbatim."""
    cut = remove_repeats(docs, verbatim=True)
    size = F.length("kept_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    named = {"text": F.col("kept_text"), "n_chars": size}
    return cut.select(*[named[c].alias(c) if c in named else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in windows of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("substring_dedup", substring_dedup), ("packing", packing)]

#: No stage but the base rules can be said in SQL; tests/llm compares the whole run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
