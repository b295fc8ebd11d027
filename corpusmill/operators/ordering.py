"""Orders, top-n, samples and length buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import preview
from corpusmill.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id puts the partition number above 33 row bits


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Dense 1-based rank over a range sort: no single-partition window.

    The sorted rows are checkpointed once, so the per-partition counts and the rows agree. Only one count
    per partition is windowed and broadcast.
    """
    ids = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_id"), _ROW_BITS)
    counts = ids.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_id") - F.shiftleft(F.col("_part"), _ROW_BITS)
    return (ids.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + within + 1).drop("_part", "_before", "_id"))


def top_k(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest counts in ``by`` (1 and more), ties by the smallest ``tie``.

    A plain ordered limit takes k rows from every task to one place. Here a histogram of the counts (about a thousand levels) tells
    first which level holds the k-th row, and only rows from that level up are ordered: k rows and those that share the last level.
    Both uses of ``df`` share its last shuffle.
    """
    level = F.floor(F.log2(F.col(by).cast("double")) * 16).cast("int")
    above = Window.orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, -1)
    levels = df.groupBy(level.alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
    cut = levels.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).filter(F.col("_above") < k).agg(F.min("_level")).scalar()
    return df.filter(level >= cut).orderBy(F.desc(by), F.asc(tie)).limit(k)


def feedback_newest_first(feedback: DataFrame) -> DataFrame:
    return feedback.orderBy(F.desc("created_at"), F.desc("id"))


def recent_feedback(feedback: DataFrame, limit: int = 10) -> DataFrame:
    """The newest ``limit * 5`` rows."""
    return feedback_newest_first(feedback).limit(limit * 5)


def recent_listing(feedback: DataFrame, n: int = 5, width: int = 50) -> DataFrame:
    return feedback_newest_first(feedback).limit(n).select(
        "id", preview("question", width).alias("question"), "source", "confidence_score", "created_at")


def curriculum_order(df: DataFrame, question: str = "question_clean", answer: str = "answer_clean",
                     key: str = "row_id") -> DataFrame:
    """Short pairs first; adds complexity and curriculum_rank."""
    scored = df.withColumn("complexity", F.length(question) + F.length(answer))
    return global_rank(scored, [F.asc("complexity"), F.asc(key)], "curriculum_rank")


def seeded_order(key: str, seed: int) -> Column:
    """Deterministic shuffle key of a row: 32 bits of a digest of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")


def sample_n(df: DataFrame, n: int, key: str = "row_id", seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones on every run and partitioning."""
    return df.orderBy(seeded_order(key, seed), F.col(key)).limit(n)


def length_buckets(df: DataFrame, column: str, width: int = 50) -> DataFrame:
    return df.withColumn("length_bucket", F.floor(F.length(column) / width))


def write_length_batches(df: DataFrame, path: str, column: str, width: int = 50, mode: str = "overwrite") -> None:
    """Files that hold rows of similar length, so that batches need little padding."""
    bucketed = length_buckets(df, column, width)
    (bucketed.repartitionByRange(F.col("length_bucket"), F.xxhash64(column)).sortWithinPartitions("length_bucket")
     .write.mode(mode).parquet(path))
