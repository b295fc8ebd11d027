"""Feedback memory as a DataFrame: upsert, statistics, corrections, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions.scores import estimate_confidence
from corpusmill.functions.text import question_key

SCHEMA = """id long, question string, question_hash string, base_answer string, improvement string, reflection string,
source string, confidence_score double, improvement_type string, timestamp string, created_at timestamp"""
AUTO, CORRECTED = "auto-reflection", "user-correction"


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest order per key: a grouped maximum, merged before the shuffle, so that a hot key stays
    cheap. The order must be total."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, "_best.*").select(df.columns)


def new_id(key: Column | str) -> Column:
    """The id of a question that comes in without one: 60 bits of its digest, so a repeated run gives the same id."""
    return F.conv(F.left(key, F.lit(15)), 16, 10).cast("long")


def upsert_feedback(base: DataFrame, delta: DataFrame, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Insert or replace by the full question digest; the newest row of a question wins (D17). Rows without id get one."""
    rows = base.unionByName(delta, allowMissingColumns=True).withColumn("_key", question_key("question"))
    if "id" in rows.columns:
        rows = rows.withColumn("id", F.coalesce("id", new_id("_key")))
    return latest_per_key(rows, ["_key"], order).drop("_key")


def mix_feedback(train: DataFrame, feedback: DataFrame) -> DataFrame:
    """Training pairs and (question, improvement) of the feedback, with their origin."""
    pairs = feedback.select(F.col("question").alias("question_clean"), F.col("improvement").alias("answer_clean"))
    return train.select("question_clean", "answer_clean").withColumn("origin", F.lit("train")).unionByName(
        pairs.withColumn("origin", F.lit("feedback")))


def feedback_stats(feedback: DataFrame, as_of: Column) -> DataFrame:
    return feedback.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("source") == AUTO).alias("auto_saved"),
        F.count_if(F.col("source") == CORRECTED).alias("user_corrections"),
        F.count_if(F.col("created_at") >= as_of - F.expr("INTERVAL 7 DAYS")).alias("last_7_days"),
        F.round(F.coalesce(F.avg("confidence_score"), F.lit(0.0)), 3).alias("avg_confidence"))


def usage_counters(usage: DataFrame) -> DataFrame:
    """One row of counts from usage events of kind llm_answer, reflection and reuse."""
    return usage.agg(
        F.count_if(F.col("kind") == "llm_answer").alias("llm_answers"),
        F.count_if(F.col("kind") == "reflection").alias("reflections"),
        F.count_if(F.col("kind") == "reuse").alias("reuse_count"))


def memory_overview(feedback: DataFrame, usage: DataFrame, as_of: Column) -> DataFrame:
    """(metric, value): statistics, counters, reuse rate and the last update as epoch seconds."""
    stats = feedback_stats(feedback, as_of)
    last = feedback.agg(F.unix_timestamp(F.max("created_at")).cast("double").alias("last_update"))
    counters = usage_counters(usage).withColumn("reuse_rate", F.round(F.coalesce(
        F.try_divide(F.col("reuse_count"), F.col("reuse_count") + F.col("llm_answers")), F.lit(0.0)), 3))
    parts = [df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])))
        for df in (stats, counters, last)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def expire_feedback(feedback: DataFrame, as_of: Column, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(kept, expired): rows created before ``as_of - days`` expire."""
    old = F.col("created_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return feedback.filter(~old), feedback.filter(old)


def auto_feedback(answered: DataFrame, now: Column) -> DataFrame:
    """Feedback rows from question, base_answer, improvement, reflection."""
    return answered.select(
        "id", "question", F.left(question_key("question"), F.lit(8)).alias("question_hash"), "base_answer",
        "improvement", "reflection", F.lit(AUTO).alias("source"),
        estimate_confidence("reflection").alias("confidence_score"), F.lit("answer-reflection").alias(
            "improvement_type"), now.cast("string").alias("timestamp"), now.alias("created_at"))


def apply_corrections(feedback: DataFrame, corrections: DataFrame) -> DataFrame:
    """A user's correction replaces the improvement of its question; unknown questions come in as new rows with a new id.

    The newest correction of a question counts. ``corrections``: question, user_correction, reflection, created_at.
    """
    newest = latest_per_key(
        corrections.withColumn("_key", question_key("question")), ["_key"], ["created_at", "user_correction"])
    newest = newest.select("_key", F.col("question").alias("_question"), "user_correction",
                           F.col("reflection").alias("_reflection"), F.col("created_at").alias("_at"))
    joined = feedback.withColumn("_key", question_key("question")).join(newest, "_key", "full_outer")
    hit = F.col("user_correction").isNotNull()

    def pick(new, old):
        return F.when(hit, new).otherwise(F.col(old)).alias(old)

    return joined.select(
        F.coalesce("id", new_id(F.col("_key"))).alias("id"), F.coalesce("question", "_question").alias("question"),
        F.left("_key", F.lit(8)).alias("question_hash"), "base_answer",
        pick(F.col("user_correction"), "improvement"),
        F.when(hit, F.coalesce("_reflection", "reflection")).otherwise(F.col("reflection")).alias("reflection"),
        pick(F.lit(CORRECTED), "source"), pick(F.lit(1.0), "confidence_score"),
        pick(F.lit("user-feedback"), "improvement_type"), pick(F.col("_at").cast("string"), "timestamp"),
        pick(F.col("_at"), "created_at"))
