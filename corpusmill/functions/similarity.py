"""Question similarity: exact, containment, word overlap and character sequence."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import let, strip, words

CONTAINED = 0.9
SEQUENCE_WEIGHT, WORD_WEIGHT = 0.6, 0.4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(c: Column | str) -> Column:
    return F.lower(strip(c))


def exact_contains(a: Column | str, b: Column | str) -> Column:
    """1.0 for equal texts, 0.9 if one holds the other, else 0.0 (inputs normalised)."""
    both = F.struct(normalized(a).alias("x"), normalized(b).alias("y"))
    return let(both, lambda v: F.when(v["x"] == v["y"], 1.0).when(
        F.contains(v["x"], v["y"]) | F.contains(v["y"], v["x"]), CONTAINED).otherwise(0.0))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """Jaccard of two arrays without repeats; 0 if either is empty."""
    sizes = F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(a).alias("a"), F.size(b).alias("b"))
    return let(sizes, lambda n: F.when((n["a"] == 0) | (n["b"] == 0), 0.0).otherwise(
        n["both"] / (n["a"] + n["b"] - n["both"])))


def word_set(c: Column | str) -> Column:
    return F.array_distinct(words(c))


def word_jaccard(a: Column | str, b: Column | str) -> Column:
    sets = F.struct(word_set(normalized(a)).alias("x"), word_set(normalized(b)).alias("y"))
    return let(sets, lambda v: jaccard_of_sets(v["x"], v["y"]))


def levenshtein_ratio(a: Column | str, b: Column | str) -> Column:
    """Native approximation of the sequence ratio."""
    longest = F.greatest(F.length(_col(a)), F.length(_col(b)))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(_col(a), _col(b)) / longest)


def ratio_bound(a: Column, b: Column) -> Column:
    """No sequence ratio of two texts of these lengths can be higher."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of each pair; use it on pruned pairs."""
    return pd.Series([
        None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)
    ], dtype="float64")


def ratio_if_enough(x: str, y: str, need: float) -> float:
    matcher = difflib.SequenceMatcher(None, x, y)
    bound = matcher.quick_ratio()
    return bound if bound < need else matcher.ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio_at_least(a: pd.Series, b: pd.Series, need: pd.Series) -> pd.Series:
    """The ratio where it can reach ``need``; otherwise an upper bound below ``need``."""
    return pd.Series([ratio_if_enough(x, y, n) for x, y, n in zip(a, b, need)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def sequence_ratios_at_least(a: pd.Series, many: pd.Series, needs: pd.Series) -> pd.Series:
    """As above for one text against a short array of texts."""
    return pd.Series([
        [ratio_if_enough(x, y, n) for y, n in zip(ys, ns)] for x, ys, ns in zip(a, many, needs)
    ])


def blended(sequence: Column, jaccard: Column) -> Column:
    return sequence * SEQUENCE_WEIGHT + jaccard * WORD_WEIGHT


def question_similarity(asked: Column | str, stored: Column | str) -> Column:
    """Exact, containment, else the blend; the stored question is the second argument."""
    quick = exact_contains(asked, stored)
    return F.when(quick > 0, quick).otherwise(
        blended(sequence_ratio(normalized(asked), normalized(stored)), word_jaccard(asked, stored)))
