"""QA pairs, feedback and usage events derived from the sample tables (joins and projections over whole tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.functions.text import first_words, question_hash

_TURNS = 1_000_000  # row_id = conv_id * _TURNS + turn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a sample of fewer file parts than cores is dealt over them in turn, by no key, so that no later shuffle is saved."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn and the assistant turn behind it; remarks and improvements are the next user and assistant turn.

    Turns meet under (conversation, turn), so one long conversation is spread like many short ones.
    """
    turns = table(spark, sf_dir, "conversations")

    def later(steps: int, role: str, name: str) -> DataFrame:
        return turns.filter(F.col("role") == role).select(
            "conv_id", (F.col("turn") - steps).alias("turn"), F.col("text").alias(name))

    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    on = ["conv_id", "turn"]
    return (asked.join(later(1, "assistant", "answer"), on)
            .join(later(2, "user", "remarks"), on, "left").join(later(3, "assistant", "improvements"), on, "left")
            .select((F.col("conv_id") * _TURNS + F.col("turn")).alias("row_id"), "conv_id", "turn", "question",
                    "answer", "remarks", "improvements"))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pairs: the first one to eight words ask, the whole text answers."""
    docs = documents(spark, sf_dir)
    asked = None
    for n in range(1, 9):
        case = F.pmod("doc_id", F.lit(8)) == n - 1
        asked = F.when(case, first_words("text", n)) if asked is None else asked.when(case, first_words("text", n))
    return docs.select(F.col("doc_id").alias("row_id"), asked.alias("question"), F.col("text").alias("answer"),
                       F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("source")).alias("remarks"),
                       F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat("lang", F.lit(": "), "source", F.lit(
                           " again"))).alias("improvements"))


def with_time(events: DataFrame) -> DataFrame:
    """Event time as a timestamp: watermarks reject timestamps without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def feedback_of(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """One feedback row per pair; time, source and confidence come from the pair's event."""
    link = pairs.withColumn("event_id", F.col("conv_id") * 8 + F.col("turn"))
    joined = with_time(events).join(link, "event_id")
    return joined.select(
        F.col("row_id").alias("id"), "question", question_hash("question").alias("question_hash"),
        F.col("answer").alias("base_answer"), F.coalesce("improvements", "answer").alias("improvement"),
        F.coalesce("remarks", F.lit("")).alias("reflection"),
        F.when(F.col("event_type") == "purchase", "user-correction").otherwise("auto-reflection").alias("source"),
        F.least(F.round(F.col("value") / 25, 2), F.lit(1.0)).alias("confidence_score"),
        F.lit("conversation").alias("improvement_type"), F.col("ts").cast("string").alias("timestamp"),
        F.col("ts").alias("created_at"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_of(table(spark, sf_dir, "events"), qa_pairs(spark, sf_dir))


KINDS = {"click": "llm_answer", "view": "reflection", "purchase": "reuse"}


def usage_kind() -> Column:
    out = None
    for event, kind in KINDS.items():
        case = F.col("event_type") == event
        out = F.when(case, kind) if out is None else out.when(case, kind)
    return out.otherwise("other")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_time(table(spark, sf_dir, "events")).select(F.col("ts").alias("event_time"),
                                                            usage_kind().alias("kind"))


def document_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored questions; the number orders them in time."""
    docs = documents(spark, sf_dir)
    start = F.lit("2024-01-01").cast("timestamp").cast("long")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("question"),
                       (start + F.col("doc_id")).cast("timestamp").alias("created_at"))
