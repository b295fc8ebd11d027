"""Preparation report: a metrics frame, and Markdown rendered from that small result."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from corpusmill.operators.profile import pipeline_stats, profile_dataset, target_distribution


def metrics_frame(raw: DataFrame, deduplicated: DataFrame, final: DataFrame, text: str, label: str | None,
                  key: str = "row_id") -> DataFrame:
    """(section, key, value) of a preparation run; the key column is no part of the profile."""
    stats = pipeline_stats(raw, deduplicated, final)
    out = stats.select(F.inline(F.array(*[
        F.struct(F.lit("pipeline").alias("section"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
        for c in stats.columns]))).unionByName(profile_dataset(raw.drop(key), text))
    if label:
        counts = target_distribution(raw, label)
        out = out.unionByName(counts.select(F.lit("target").alias("section"), F.col(label).cast("string").alias("key"),
                                            F.col("n").cast("double").alias("value")))
    return out


_TITLES = {"pipeline": "Rows", "rows": "Input", "missing": "Missing values", "text": "Text statistics",
           "target": "Target distribution"}


def render_markdown(metrics: DataFrame, settings: Mapping | None = None) -> str:
    """Markdown text of a metrics frame: one line per metric."""
    rows = metrics.orderBy("section", "key").collect()  # one row per column, metric and class
    lines = ["# Data preparation report", ""]
    if settings:
        lines += ["## Settings", "```json", json.dumps(dict(settings), indent=2, sort_keys=True, default=str), "```", ""]
    for section, title in _TITLES.items():
        found = [r for r in rows if r["section"] == section]
        if found:
            lines += [f"## {title}"] + [
                f"- **{r['key']}:** {'n/a' if r['value'] is None else format(r['value'], 'g')}" for r in found] + [""]
    return "\n".join(lines)
