"""Quality rules: base counts of a text and the hashed n-gram log-likelihood ratio of trusted against raw texts.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.words import stored
from corpusmill.session import compute_once

_RUN = r"[\x20\x09-\x0D]+"
_WHITE = " \t\n\x0b\f\r"
_SYMBOLS = "[#*$%&|<>]+"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.col(text), _RUN), "")


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(words: str, hashes: str) -> Column:
    """Hashes of the words and of the last three characters of each word."""
    return F.concat(F.col(hashes), F.transform(words, lambda w: F.xxhash64(F.lit(3), F.substring(w, -3, 3))))


def _joined(values: str, apart: int) -> Column:
    """Hash of each value with the one ``apart`` places on: joins runs to runs of twice the length."""
    count = F.greatest(F.size(values) - apart, F.lit(0))
    return F.zip_with(F.slice(values, 1, count), F.slice(values, apart + 1, count), lambda a, b: F.xxhash64(a, b))


def base_counts(docs: DataFrame, text: str = "__text") -> DataFrame:
    """Adds ``__words``, ``__hashes`` and the five counts of the base rules to rows with a text that isn't null."""
    held = [F.col(f"`{c}`") for c in docs.columns]
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: F.btrim(line, F.lit(_WHITE)) != "")
    rows = compute_once(docs, {"__words": _words(text), "__lines": lines})
    rows = compute_once(rows, {
        "__hashes": _hashes("__words"), "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}).drop("__lines")
    rows = compute_once(rows, {"__runs": _joined("__hashes", 1)})  # of 2 words
    rows = compute_once(rows, {"__runs": _joined("__runs", 2)})  # of 4
    # A window of 8 met twice holds a run of 4 met twice; most texts have none and stop here.
    rows = compute_once(rows, {"__runs": F.when(F.size(F.array_distinct("__runs")) < F.size("__runs"), _joined("__runs", 4))})
    rows = compute_once(rows, {"__sorted": F.expr(
        "CASE WHEN size(array_distinct(__runs)) < size(__runs) THEN sort_array(transform(__runs, (h, i) -> named_struct('h', h, 'i', i))) END")})
    rows = compute_once(rows, {"__starts": F.expr(
        "sort_array(filter(transform(__sorted, (x, j) -> CASE WHEN get(__sorted, j - 1).h = x.h OR get(__sorted, j + 1).h = x.h THEN x.i END), "
        "i -> i IS NOT NULL))")})
    covered = "aggregate(transform(__starts, (x, j) -> CAST(least(8, get(__starts, j + 1) - x) AS BIGINT)), 0L, (a, x) -> a + x)"
    return rows.select(*held, "__words", "__hashes", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.coalesce(F.expr(covered), F.lit(0).cast("long")).alias("n_repeat_words"))


def ratio_table(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 1 << 13, target_rows: int = 4096) -> DataFrame:
    """One row ``(ratios array<double>)``: per bucket log(trusted share) - log(share of all rows), both smoothed by one.

    The raw side counts every row. The trusted side is a bounded sample, as a classifier may use: the ``target_rows``
    keys of ``trusted`` with the smallest hashes, so the broadcast is bounded too. Without trusted rows all ratios are 0.
    """
    chosen = trusted.select(F.col(f"`{key}`").alias("__key")).where("__key IS NOT NULL").distinct().orderBy(F.xxhash64("__key"), "__key").limit(target_rows)
    flagged = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")).join(
        F.broadcast(chosen.withColumn("__good", F.lit(1).cast("long"))), "__key", "left")
    words = compute_once(flagged.select("__text", F.coalesce("__good", F.lit(0).cast("long")).alias("__good")), {"__words": _words("__text")})
    words = compute_once(words.drop("__text"), {"__hashes": _hashes("__words")})
    counts = words.select("__good", F.explode(_grams("__words", "__hashes")).alias("gram")).groupBy(
        F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket")).agg(
        F.count("*").alias("raw"), F.sum("__good").alias("good"))
    none = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("good"))
    full = stored(counts.unionByName(none).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")), "ratios")
    raw, good = full.agg(F.sum("raw").cast("double")).scalar(), full.agg(F.sum("good").cast("double")).scalar()
    ratio = F.when(good == 0, F.lit(0.0)).otherwise(
        F.log((F.col("good") + 1) / (good + buckets)) - F.log((F.col("raw") + 1) / (raw + buckets)))
    pairs = full.select(F.struct(F.col("bucket"), ratio.alias("ratio")).alias("p"))
    return stored(pairs.agg(F.expr("transform(sort_array(collect_list(p)), x -> x.ratio)").alias("ratios")), "ratios")


def quality_rules(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = -0.5, buckets: int = 1 << 13,
                  target_rows: int = 4096) -> DataFrame:
    """``docs`` plus the base counts, ``base_failed``, ``score`` and ``kept``; no row is dropped.

    ``score`` is the mean log-likelihood ratio over the words of a text and their last three characters; ``kept`` when the base rules hold and
    ``score >= threshold``. Base rules fail with under 20 words, or with more than 30 % of the words in 8-word windows met twice. A
    null or empty text has no words and fails; null keys are never trusted; repeated rows get equal results; an empty table
    stays empty. Columns with the names of results are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    ratios = ratio_table(docs, trusted, key, text, buckets, target_rows).scalar()
    rows = docs.drop(*[c for c in added if c != key and c != text]).withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    counted = compute_once(base_counts(rows), {"__grams": _grams("__words", "__hashes")})
    counted = counted.withColumn("__ratios", ratios)
    table = compute_once(counted, {"score": F.when(F.size("__grams") > 0, F.aggregate(
        "__grams", F.lit(0.0), lambda a, g: a + F.get("__ratios", F.pmod(g, F.lit(buckets)).cast("int"))) / F.size("__grams")).otherwise(F.lit(0.0))})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return table.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold)).drop("__text", "__words", "__hashes", "__grams", "__ratios")
