"""Row predicates and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions.text import word_count


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def not_blank(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))


def drop_empty_clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.filter(not_blank(c))
    return df


def has_min_size(question: str = "question_clean", answer: str = "answer_clean", question_chars: int = 10,
                 question_words: int = 3, answer_chars: int = 15, answer_words: int = 4) -> Column:
    return ((F.length(question) >= question_chars) & (word_count(question) >= question_words)
            & (F.length(answer) >= answer_chars) & (word_count(answer) >= answer_words))


def min_size_filter(df: DataFrame, question: str = "question_clean", answer: str = "answer_clean") -> DataFrame:
    return df.filter(has_min_size(question, answer))


def min_chars_filter(df: DataFrame, question: str = "question_clean", answer: str = "answer_clean",
                     question_chars: int = 0, answer_chars: int = 0) -> DataFrame:
    """Strictly longer than the limits: 0/0 for local sets, 10/20 for the strict variant."""
    return df.filter((F.length(question) > question_chars) & (F.length(answer) > answer_chars))


def confident_feedback(feedback: DataFrame, least: float = 0.5, min_rows: int = 10) -> DataFrame:
    """Rows above ``least`` confidence; refused with too few rows or none left."""
    if feedback.limit(min_rows).count() < min_rows:
        raise ValueError(f"need at least {min_rows} feedback rows")
    kept = feedback.filter(F.col("confidence_score") > least)
    if kept.isEmpty():
        raise ValueError(f"no feedback above confidence {least}")
    return kept


def by_source(feedback: DataFrame, source: str) -> DataFrame:
    return feedback.filter(F.col("source") == source)


def since(df: DataFrame, as_of: Column, days: int, column: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``, the boundary included."""
    return df.filter(F.col(column) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
