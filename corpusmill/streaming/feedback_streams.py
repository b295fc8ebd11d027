"""Feedback, counters, activity and recall over streams.

A memory store is a folder with one Parquet directory per stream and micro-batch, and one for a compacted snapshot. A batch
that is replayed overwrites its own directory, a stream with a new checkpoint never one of another stream, and reading takes the newest
row per question, so the result does not depend on retries.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions.text import question_key
from corpusmill.operators.feedback import expire_feedback, latest_per_key
from corpusmill.operators.recall import recall_join

_ORDER = ["created_at", "id", "batch", "stream"]


def _folder(batch: DataFrame, store: str, checkpoint: str, batch_id: int) -> str:
    """The directory of one batch: the stream's id, which its checkpoint keeps over restarts, and the batch number."""
    stream = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
    return f"{store}/stream={stream}/batch={batch_id}"


def stream_upsert_feedback(stream: DataFrame, store: str, checkpoint: str, trigger: dict | None = None
                           ) -> StreamingQuery:
    """Append each batch's newest row per question to the store."""
    def save(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("_key", question_key("question"))
        latest_per_key(keyed, ["_key"], ["created_at", "id"]).drop("_key").write.mode("overwrite").parquet(
            _folder(batch, store, checkpoint, batch_id))

    return (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The newest row per question over all batches."""
    rows = spark.read.parquet(store).withColumn("_key", question_key("question"))
    return latest_per_key(rows, ["_key"], [c for c in _ORDER if c in rows.columns]).drop("_key", "batch", "stream")


def compact_store(spark: SparkSession, store: str, target: str, as_of: Column | None = None,
                  days: int = 90) -> None:
    """Write the store's current rows as the snapshot of another store, with ``as_of`` only those of the last days.

    A later snapshot replaces an earlier one; streams on the target write beside it.
    """
    if store.rstrip("/") == target.rstrip("/"):
        raise ValueError("compact into another folder: the store is read while the snapshot is written")
    rows = read_store(spark, store)
    if as_of is not None:
        rows, _ = expire_feedback(rows, as_of, days)
    rows.write.mode("overwrite").parquet(f"{target}/stream=snapshot/batch=0")


def stream_usage_counters(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
                          ) -> StreamingQuery:
    """Running count per kind; each batch writes the few totals as a new version."""
    def save(totals: DataFrame, batch_id: int) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return (stream.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete")
            .foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    versions = spark.read.parquet(path)
    return versions.filter(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")


def activity(events: DataFrame, window: str = "7 days", slide: str | None = "1 day", delay: str = "1 hour",
             time: str = "event_time") -> DataFrame:
    """Events per kind and window; works on a stream and on a table."""
    return (events.withWatermark(time, delay)
            .groupBy(F.window(time, window, slide) if slide else F.window(time, window), "kind")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "kind", "n"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", time: str = "event_time",
             key: str = "kind") -> DataFrame:
    """Bursts of events of one key with no pause as long as ``gap``."""
    return (events.withWatermark(time, delay).groupBy(F.session_window(time, gap), key)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "n"))


def stream_parts(stream: DataFrame, part: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None
                 ) -> StreamingQuery:
    """``part`` (``activity`` or ``sessions``) of each batch, finished or not; reading joins the parts of a window or session.

    Nothing waits for a watermark, so open windows are in the store at once and late rows count.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        part(batch).write.mode("overwrite").parquet(_folder(batch, path, checkpoint, batch_id))

    return (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Events per kind and window over all batches, as ``activity`` counts them in the whole table."""
    return spark.read.parquet(path).groupBy("window_start", "window_end", "kind").agg(F.sum("n").alias("n"))


def read_sessions(spark: SparkSession, path: str, key: str = "kind") -> DataFrame:
    """Sessions over all batches: parts that overlap are one, as ``sessions`` finds them in the whole table."""
    length = F.concat(F.unix_micros("session_end") - F.unix_micros("session_start"), F.lit(" microseconds"))
    return (spark.read.parquet(path).groupBy(F.session_window("session_start", length), key).agg(F.sum("n").alias("n"))
            .select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"))


def stream_to_parquet(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append finished rows; windows come out once the watermark has passed them."""
    return (stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def dedupe_questions(stream: DataFrame, delay: str = "7 days", time: str = "created_at") -> DataFrame:
    """The first row of each question within the watermark."""
    return (stream.withColumn("question_key", question_key("question")).withWatermark(time, delay)
            .dropDuplicatesWithinWatermark(["question_key"]))


def stream_recall(questions: DataFrame, store: str, path: str, checkpoint: str, threshold: float = 0.7,
                  recent_n: int | None = 50, score: str = "full", trigger: dict | None = None) -> StreamingQuery:
    """Recall each batch of questions against the store as it is then."""
    def save(batch: DataFrame, batch_id: int) -> None:
        memory = read_store(batch.sparkSession, store)
        recall_join(batch, memory, threshold, recent_n, score).write.mode("overwrite").parquet(
            _folder(batch, path, checkpoint, batch_id))

    return (questions.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
