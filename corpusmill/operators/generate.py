"""Apply a user's model to a table: answers, critiques and improvements."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.session import small_batches

# A factory makes the model once per task; the model maps a list of prompts to a list of texts.
Model = Callable[[Sequence[str]], Sequence[str]]
RESULT = "text string, status string, error string"


def _one(model: Model, prompt: str, retry_words: int) -> tuple[str | None, str, str | None]:
    try:
        return model([prompt])[0].strip(), "ok", None
    except Exception as first:
        try:
            return model([" ".join(prompt.split()[:retry_words])])[0].strip(), "retried", str(first)
        except Exception as second:
            return None, "failed", str(second)


def apply_generator(df: DataFrame, make_model: Callable[[], Model], prompt: str, out: str = "generated",
                    retry_words: int = 100, partitions: int | None = None) -> DataFrame:
    """Adds a struct (text, status, error). Only the prompt column leaves the JVM.

    A failing batch is repeated row by row; a failing row is tried once more with its first ``retry_words`` words and
    then reported as failed. Rows without a prompt are skipped.
    """
    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for prompts in batches:
            asked = prompts[prompts.notna()]
            rows = {}
            try:
                texts = list(model(asked.tolist())) if len(asked) else []
                if len(texts) != len(asked):
                    raise ValueError("one text per prompt expected")
                rows = {i: (t.strip(), "ok", None) for i, t in zip(asked.index, texts)}
            except Exception:
                rows = {i: _one(model, p, retry_words) for i, p in asked.items()}
            yield pd.DataFrame([rows.get(i, (None, "skipped", None)) for i in prompts.index],
                               columns=["text", "status", "error"])

    small_batches(df.sparkSession)
    source = df.repartition(partitions) if partitions else df
    # A model may answer differently each time: never run it twice for one reference.
    return source.withColumn(out, run.asNondeterministic()(F.col(prompt)))
