"""Vocabularies, token encoding and model examples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.functions import sequences as seq
from corpusmill.operators.filters import not_blank
from corpusmill.operators.ordering import global_rank, top_k
from corpusmill.session import cut_lineage, small_batches

# The characters that part words, and the first id of a word.
FILTERED = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
FIRST_ID = 2
DUMMY_WORD = "empty"
# A vocabulary up to this many words and bytes goes to every worker; a larger one is joined by shuffle.
BROADCAST_WORDS, BROADCAST_BYTES = 200_000, 16 << 20

# Cap and least frequency per column.
VOCABULARY_SIZES = {
    "question_clean": (5000, 2), "answer_clean": (8000, 2), "remarks_clean": (3000, 1),
    "improvements_clean": (3000, 1),
}


def vocabulary_words(c: Column | str) -> Column:
    """Lower-case words between filtered characters and blanks."""
    spaced = F.translate(F.lower(F.col(c) if isinstance(c, str) else c), FILTERED, " " * len(FILTERED))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def build_vocabulary(df: DataFrame, column: str, max_size: int | None = 5000, min_freq: int = 1) -> DataFrame:
    """(word, freq, id): most frequent first, ties by word; ids from 2 (0 pads, 1 is unknown)."""
    counts = (df.filter(not_blank(column)).select(F.explode(vocabulary_words(column)).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= min_freq))
    order = [F.desc("freq"), F.asc("word")]
    if max_size is None:
        return global_rank(counts, order, "rank").select(
            "word", "freq", (F.col("rank") + FIRST_ID - 1).cast("int").alias("id"))
    # The limit bounds the window to max_size rows.
    return top_k(counts, "freq", "word", max_size).select(
        "word", "freq", (F.row_number().over(Window.orderBy(*order)) + FIRST_ID - 1).alias("id"))


def or_dummy(vocabulary: DataFrame) -> DataFrame:
    """A vocabulary without words gets one dummy word (checked with a one-row job)."""
    if not vocabulary.isEmpty():
        return vocabulary
    return vocabulary.sparkSession.createDataFrame([(DUMMY_WORD, 1, FIRST_ID)], vocabulary.schema)


def vocab_size(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg((F.count(F.lit(1)) + FIRST_ID).alias("vocab_size"))


def token_encoder(vocabulary: DataFrame, max_words: int = BROADCAST_WORDS, max_bytes: int = BROADCAST_BYTES) -> Callable[[Column], Column] | None:
    """A function from a column of word arrays to their id arrays, unknown words as 1; None if the vocabulary is counted too large.

    The words are a sorted Arrow table that every worker gets once, and a batch looks all its words up in one vectorised probe: encoding is
    a projection, no word is a row and nothing is shuffled.
    """
    spark, table = vocabulary.sparkSession, cut_lineage(vocabulary.select("word", F.col("id").cast("int").alias("id")).where("word IS NOT NULL"))
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if rows > max_words or size > max_bytes:
        return None
    small_batches(spark)
    known = table.toArrow().sort_by("word")
    shared = spark.sparkContext.broadcast((known.column("word").combine_chunks(), known.column("id").to_numpy()))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(words: pa.Array) -> pa.Array:
        names, numbers = shared.value
        place = pc.index_in(words.flatten(), value_set=names.cast(words.type.value_type))
        found = np.append(numbers, seq.UNKNOWN)[place.fill_null(len(numbers)).to_numpy()].astype(np.int32)
        ends = np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(words), 0).to_numpy()))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found))

    return ids


def _words(column: str, maxlen: int | None) -> Column:
    tokens = vocabulary_words(F.coalesce(F.col(column), F.lit("")))
    return tokens if maxlen is None else F.slice(tokens, 1, maxlen)


def _encode_by_join(df: DataFrame, vocabulary: DataFrame, column: str, key: str, maxlen: int | None, out: str) -> DataFrame:
    """The same by a join on the word, for vocabularies that no worker should hold."""
    exploded = df.select(key, F.posexplode_outer(_words(column, maxlen)).alias("pos", "word"))
    found = exploded.join(vocabulary.select("word", "id"), "word", "left").select(
        key, F.when(F.col("word").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(seq.UNKNOWN)).alias("id"))).alias("x"))
    return found.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x")).select(key, F.col("x.id").alias(out))


def encode_columns(df: DataFrame, columns: Mapping[str, tuple[str, DataFrame, int | None]], key: str = "row_id", max_words: int = BROADCAST_WORDS) -> DataFrame:
    """(key, ids ...): for each name its ``(column, vocabulary, maxlen)``; see ``encode_tokens``. One projection over all columns.

    A vocabulary above ``max_words`` (or its bytes above the bound) is joined instead, which shuffles the words before its ``maxlen``.
    """
    direct, joined = {}, []
    for out, (column, vocabulary, maxlen) in columns.items():
        encode = token_encoder(vocabulary, max_words)
        if encode is not None:
            direct[out] = encode(_words(column, maxlen))
        else:
            joined.append(_encode_by_join(df, vocabulary, column, key, maxlen, out))
    coded = df.select(key, *[c.alias(out) for out, c in direct.items()])
    for ids in joined:
        coded = coded.join(ids, key, "left")
    cut = {out: maxlen for out, (_, _, maxlen) in columns.items()}
    return coded.select(key, *[F.col(out) if n is None else seq.pad_truncate(out, n).alias(out) for out, n in cut.items()])


def encode_tokens(df: DataFrame, vocabulary: DataFrame, column: str, key: str = "row_id", maxlen: int | None = None,
                  out: str = "ids", max_words: int = BROADCAST_WORDS) -> DataFrame:
    """(key, ids): the whole text's word ids in order, unknown words as 1, no words as an empty array.

    ``maxlen`` pads or truncates to a constant size; words behind it are then never looked up.
    """
    return encode_columns(df, {out: (column, vocabulary, maxlen)}, key, max_words)


def verify_token_ranges(df: DataFrame, ids: str, size: Column | int) -> DataFrame:
    """Smallest and largest id, and how many reach the vocabulary size."""
    return df.select(F.explode(ids).alias("id")).agg(
        F.min("id").alias("min_id"), F.max("id").alias("max_id"),
        F.count_if(F.col("id") >= size).alias("out_of_range"))


def model_examples(df: DataFrame, vocabulary: DataFrame, prompt: Column, answer: str, key: str = "row_id",
                   input_len: int = 512, label_len: int = 512) -> DataFrame:
    """(key, input_ids, attention_mask, labels) with our vocabulary; words behind the lengths are not looked up."""
    sides = df.select(key, prompt.alias("_a"), F.col(answer).alias("_b"))
    both = encode_columns(sides, {"a": ("_a", vocabulary, input_len), "b": ("_b", vocabulary, label_len)}, key)
    return both.select(key, F.col("a").alias("input_ids"), seq.attention_mask("a").alias("attention_mask"), seq.label_ids("b").alias("labels"))


def model_examples_with(df: DataFrame, tokenizer: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[int]]]],
                        prompt: Column, answer: str, input_len: int = 512, label_len: int = 512) -> DataFrame:
    """As above with a user's tokenizer, made once per task and fed Arrow batches."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = tokenizer()
        for texts in batches:
            yield pd.Series(list(run(texts.fillna("").tolist())))

    coded = df.withColumn("_a", encode(prompt)).withColumn("_b", encode(F.col(answer)))
    inputs, labels = seq.pad_truncate("_a", input_len), seq.pad_truncate("_b", label_len)
    return coded.withColumns({
        "input_ids": inputs, "attention_mask": seq.attention_mask(inputs), "labels": seq.label_ids(labels),
    }).drop("_a", "_b")
