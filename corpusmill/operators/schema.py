"""Column resolution, layout detection and required columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import strip, strip_tags

# The words that name each column.
QA_KEYWORDS = {
    "question": ("question", "quest", "q"),
    "answer": ("answer", "ans", "a", "solution", "response"),
    "remarks": ("remarks", "remark", "comment", "note", "feedback"),
    "improvements": ("improvements", "improve", "suggest", "enhance", "better"),
}


def qa_mapping(columns: Sequence[str]) -> dict[str, str]:
    """Source column per target: exact name, whole word, word prefix, then position."""
    found: dict[str, str] = {}

    def rank(column: str, target: str) -> int | None:
        name = column.strip().lower()
        parts = [p for p in re.split(r"[\W_]+", name) if p]
        if name == target:
            return 0
        if any(p in QA_KEYWORDS[target] for p in parts):
            return 1
        if any(p.startswith(k) for p in parts for k in QA_KEYWORDS[target] if len(k) > 2):
            return 2
        return None

    for level in range(3):
        for target in QA_KEYWORDS:
            if target in found:
                continue
            matches = [c for c in columns if c not in found.values() and rank(c, target) == level]
            if len(matches) > 1:
                raise ValueError(f"columns {matches} all look like {target!r}")
            if matches:
                found[target] = matches[0]
    for position, target in enumerate(QA_KEYWORDS):
        if target in found or position >= len(columns) or columns[position] in found.values():
            continue
        if all(rank(columns[position], t) is None for t in QA_KEYWORDS):
            found[target] = columns[position]
    return found


def resolve_qa_columns(df: DataFrame) -> DataFrame:
    """Rename the mapped columns to question, answer, remarks, improvements; others stay."""
    mapping = qa_mapping(df.columns)
    require_columns(df.select([df[f"`{c}`"].alias(t) for t, c in mapping.items()]), ["question", "answer"])
    return df.withColumnsRenamed({source: target for target, source in mapping.items()})


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def normalize_layout(df: DataFrame) -> DataFrame:
    """question_clean, answer_clean from a cleaned, a named or a raw tagged layout."""
    cols = df.columns
    if cols[:2] == ["question_clean", "answer_clean"]:
        return df.select("question_clean", "answer_clean")
    if {"question", "answer"} <= set(cols):
        return df.select(F.col("question").alias("question_clean"), F.col("answer").alias("answer_clean"))
    if len(cols) in (2, 3):
        raw = df.toDF(*["raw_question", "answer", "extra"][:len(cols)])
        return raw.select(strip_tags("raw_question").alias("question_clean"),
                          strip("answer").alias("answer_clean"))
    raise ValueError(f"unknown layout {cols}; expected a cleaned, question/answer or raw layout")


def mean_text_lengths(df: DataFrame) -> DataFrame:
    """One row: mean length of every string column, from one scan."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.agg(*[F.avg(F.length(F.col(f"`{c}`"))).alias(c) for c in strings])


def detect_text_column(df: DataFrame, least: float = 50) -> str:
    """First string column whose mean length is above ``least``."""
    lengths = mean_text_lengths(df)
    row = lengths.first()
    for name in lengths.columns:
        if row[name] is not None and row[name] > least:
            return name
    raise ValueError("no text column found")


def with_optional_columns(df: DataFrame, columns: Sequence[str] = ("remarks", "improvements")) -> DataFrame:
    """Missing optional columns as empty text; nulls in them become empty text."""
    missing = {c: F.lit("") for c in columns if c not in df.columns}
    return (df.withColumns(missing) if missing else df).na.fill("", list(columns))
