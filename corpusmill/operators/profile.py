"""Dataset profiles, text statistics, quality distribution and step counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import strip, word_count


def row_digest(columns: Sequence[str]) -> Column:
    """128-bit digest of a whole row, nulls told apart from empty text."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]),
                           {"ignoreNullFields": "false"}))


def count_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    counts = df.groupBy(row_digest(columns or df.columns).alias("_digest")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def profile_dataset(df: DataFrame, text: str, approximate: bool = False) -> DataFrame:
    """Long metrics (section, key, value) of the raw frame; one scan for the sums, one for the distinct digests."""
    columns = df.columns
    length = F.length(text)
    facts = {
        ("rows", "total_rows"): F.count(F.lit(1)).cast("double"),
        ("rows", "total_columns"): F.lit(float(len(columns))),
        ("text", "characters"): F.coalesce(F.sum(length), F.lit(0)).cast("double"),
        ("text", "non_null_count"): F.count(text).cast("double"),
        ("text", "avg_length"): F.avg(length),
        ("text", "max_length"): F.max(length).cast("double"),
        ("text", "min_length"): F.min(length).cast("double"),
        ("text", "empty_strings"): F.count_if(F.length(strip(text)) == 0).cast("double"),
        **{("missing", c): F.count_if(F.col(f"`{c}`").isNull()).cast("double") for c in columns},
    }
    if approximate:
        facts[("text", "unique_count")] = F.approx_count_distinct(text).cast("double")
    sums = df.agg(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), v.alias("value"))
        for (s, k), v in facts.items()]).alias("m")).select(F.inline("m"))
    repeats = count_duplicates(df).select(
        F.lit("rows").alias("section"), F.lit("duplicate_rows").alias("key"),
        F.col("duplicate_rows").cast("double").alias("value"))
    out = sums.unionByName(repeats)
    if not approximate:
        distinct = df.filter(F.col(text).isNotNull()).select(F.md5(text).alias("_digest")).distinct().agg(
            F.lit("text").alias("section"), F.lit("unique_count").alias("key"),
            F.count(F.lit(1)).cast("double").alias("value"))
        out = out.unionByName(distinct)
    return out


def target_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def text_statistics(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Word and character length statistics per column over its non-blank texts.

    Lengths are counted first, so percentiles run over (length, frequency) pairs: a few thousand per column.
    """
    texts = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("t")) for c in columns])).alias("x")).select("x.*")
    texts = texts.filter(F.length(strip("t")) > 0)
    lengths = texts.select("column", F.explode(F.array(
        F.struct(F.lit("words").alias("unit"), word_count("t").alias("n")),
        F.struct(F.lit("chars").alias("unit"), F.length("t").alias("n")))).alias("x")).select("column", "x.*")
    counted = lengths.groupBy("column", "unit", "n").agg(F.count(F.lit(1)).alias("times"))

    def percentile(p: float) -> Column:
        if accuracy:
            return F.expr(f"percentile_approx(n, {p}, {accuracy})").cast("double")
        return F.expr(f"percentile(n, {p}, times)")

    source = lengths.withColumn("times", F.lit(1)) if accuracy else counted
    return source.groupBy("column", "unit").agg(
        F.sum("times").alias("count"), F.min("n").alias("min"), F.max("n").alias("max"),
        (F.sum(F.col("n") * F.col("times")) / F.sum("times")).alias("mean"),
        percentile(0.5).alias("median"), percentile(0.75).alias("p75"), percentile(0.9).alias("p90"),
        percentile(0.95).alias("p95"))


def recommend_lengths(statistics: DataFrame, columns: Sequence[str],
                      fixed: Mapping[str, int] | None = None) -> DataFrame:
    """Sequence length per column: fixed ones, else int(p90·1.3) within 15..100, or 50 without texts."""
    fixed = fixed if fixed is not None else {"question_clean": 100, "answer_clean": 100}
    wanted = statistics.sparkSession.createDataFrame(
        [(c, fixed.get(c)) for c in columns], "column string, fixed int")
    p90 = statistics.filter(F.col("unit") == "words").select("column", "p90")
    fitted = F.least(F.greatest(F.lit(15), F.floor(F.round(F.col("p90") * 1.3, 6)).cast("int")), F.lit(100))
    return wanted.join(p90, "column", "left").select(
        "column", F.coalesce("fixed", F.when(F.col("p90").isNotNull(), fitted), F.lit(50)).alias("max_length"))


def quality_distribution(df: DataFrame, category: str = "category") -> DataFrame:
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", F.round(share, 1))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    facts = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.count_if(F.col(c).isNull()).alias("missing")) for c in columns])
    return df.agg(facts.alias("m")).select(F.inline("m"))


def step_counts(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows left after each step in order, from one pass of flags instead of one job per step."""
    passed, entries = F.lit(True), [F.struct(F.lit(0).alias("position"), F.lit("input").alias("step"),
                                             F.count(F.lit(1)).alias("rows"))]
    for i, (name, condition) in enumerate(steps.items(), 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        entries.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("step"),
                                F.count_if(passed).alias("rows")))
    return df.agg(F.array(*entries).alias("s")).select(F.inline("s"))


def pipeline_stats(raw: DataFrame, deduplicated: DataFrame, final: DataFrame) -> DataFrame:
    """original_rows, duplicates_removed, empty_removed, final_rows from three counts."""
    def n(df, name):
        return df.agg(F.count(F.lit(1)).alias(name)).scalar()

    one = raw.sparkSession.range(1)
    return one.select(n(raw, "a").alias("original_rows"), n(deduplicated, "b").alias("_dedup"),
                      n(final, "c").alias("final_rows")).select(
        "original_rows", (F.col("original_rows") - F.col("_dedup")).alias("duplicates_removed"),
        (F.col("_dedup") - F.col("final_rows")).alias("empty_removed"), "final_rows")
