"""Exact, reproducible train/validation/test splits without a global sort.

Rows are ordered by a seeded hash of their key. A histogram over the top hash bits (at most 65,536 rows) tells which
bucket holds each cut; only those buckets are ranked. The cut values come back as a scalar subquery, so a split is
a projection over the input. ``key`` must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.operators.ordering import seeded_order
from corpusmill.session import broadcast_if_small

TEST, VALIDATION, TRAIN = "test", "validation", "train"
_BUCKET_BITS = 16
MAX_CUTS = 100_000  # of more classes the cuts are joined by shuffle


def check_sizes(test_size: float, validation_size: float = 0.0) -> None:
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    if not 0 <= validation_size < 1:
        raise ValueError("validation_size must be at least 0 and below 1")
    if test_size + validation_size >= 1:
        raise ValueError("test_size + validation_size must be below 1")


def _take(n: Column, share: float) -> Column:
    """ceil of a share, guarded against float noise."""
    return F.ceil(F.round(n * F.lit(round(share, 12)), 9))


def _keyed(df: DataFrame, key: str, seed: int, *more: Column) -> DataFrame:
    hashed = seeded_order(key, seed)
    return df.select(F.col(key).alias("_key"), hashed.alias("_hash"),
                     F.shiftright(hashed, 32 - _BUCKET_BITS).alias("_bucket"), *more)


def _label(df: DataFrame, key: str, seed: int, test_end: Column, validation_end: Column) -> Column:
    here = F.struct(seeded_order(key, seed).alias("_hash"), F.col(key).alias("_key"))
    return (F.when(here <= test_end, TEST).when(here <= validation_end, VALIDATION).otherwise(TRAIN))


def split3(df: DataFrame, test_size: float = 0.2, validation_size: float = 0.1, seed: int = 42,
           key: str = "row_id", name: str = "split") -> DataFrame:
    """Adds ``split``: ceil(n·test) test rows, then ceil(rest·validation/(1-test)) validation rows."""
    check_sizes(test_size, validation_size)
    keyed = _keyed(df, key, seed)
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bucket", "_n", F.sum("_n").over(running).alias("_upto"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"))
    test_n = _take(F.col("_all"), test_size)
    validation_n = _take(F.col("_all") - test_n, validation_size / (1 - test_size))
    cuts = (
        histogram.withColumn("_cut", F.explode(F.array(
            F.struct(F.lit(TEST).alias("part"), test_n.alias("k")),
            F.struct(F.lit(VALIDATION).alias("part"), (test_n + validation_n).alias("k")))))
        .filter((F.col("_upto") - F.col("_n") < F.col("_cut.k")) & (F.col("_cut.k") <= F.col("_upto")))
        .select("_bucket", F.col("_cut.part").alias("_part"),
                (F.col("_cut.k") - F.col("_upto") + F.col("_n")).alias("_nth"))
    )
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_hash", "_key"))
    ends = (
        keyed.join(F.broadcast(cuts), "_bucket")  # two rows
        .withColumn("_place", place).filter(F.col("_place") == F.col("_nth"))
        .agg(*[F.max(F.when(F.col("_part") == p, F.struct("_hash", "_key"))).alias(p) for p in (TEST, VALIDATION)])
        .select(F.struct(TEST, VALIDATION).alias("ends")).scalar()
    )
    return (df.withColumn("_ends", ends)
            .withColumn(name, _label(df, key, seed, F.col(f"_ends.{TEST}"), F.col(f"_ends.{VALIDATION}")))
            .drop("_ends"))


def split2(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "row_id",
           name: str = "split") -> DataFrame:
    return split3(df, test_size, 0.0, seed, key, name)


def class_support(df: DataFrame, label: str, min_samples: int = 2) -> DataFrame:
    """classes, smallest class and whether a stratified split is possible."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest")).withColumn(
        "stratify", F.coalesce(F.col("smallest") >= min_samples, F.lit(False)))


def _quota(counts: DataFrame, size: str, share: float, name: str) -> DataFrame:
    """Largest-remainder quota per class for ceil(total·share) rows."""
    everything = Window.partitionBy()
    exact = F.round(F.col(size) * F.lit(round(share, 12)), 9)
    rest = F.row_number().over(Window.orderBy(F.desc("_left"), F.asc("_label")))
    return (
        counts.withColumn("_want", _take(F.sum(size).over(everything), share))
        .withColumn("_floor", F.floor(exact)).withColumn("_left", F.round(exact - F.floor(exact), 9))
        .withColumn("_short", F.col("_want") - F.sum("_floor").over(everything))
        .withColumn("_turn", rest)
        .withColumn(name, F.col("_floor") + (F.col("_turn") <= F.col("_short")).cast("long"))
        .drop("_want", "_floor", "_left", "_short", "_turn")
    )


def split_stratified(df: DataFrame, label: str, test_size: float = 0.2, validation_size: float = 0.1,
                     seed: int = 42, key: str = "row_id", min_samples: int = 2, name: str = "split") -> DataFrame:
    """As ``split3`` within every class; unstratified if a class has fewer than ``min_samples`` rows.

    Rows without a label form a class of their own for the quotas. The cuts of all classes come from one histogram over (class, top hash
    bits) and one ranking of the cut buckets; the split itself is a projection with a broadcast lookup.
    """
    check_sizes(test_size, validation_size)
    usable = class_support(df, label, min_samples).select("stratify").scalar()
    tagged = df.withColumn("_label", F.when(usable, F.coalesce(F.col(label).cast("string"), F.lit(""))).otherwise(""))
    keyed = _keyed(tagged, key, seed, F.col("_label"))
    histogram = keyed.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    classes = histogram.groupBy("_label").agg(F.sum("_n").alias("_size"))
    quotas = _quota(_quota(classes, "_size", test_size, "_test").withColumn("_rest", F.col("_size") - F.col("_test")),
                    "_rest", validation_size / (1 - test_size), "_validation")
    running = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cuts = (
        histogram.withColumn("_upto", F.sum("_n").over(running)).join(quotas, "_label")
        .withColumn("_cut", F.explode(F.array(
            F.struct(F.lit(TEST).alias("part"), F.col("_test").alias("k")),
            F.struct(F.lit(VALIDATION).alias("part"), (F.col("_test") + F.col("_validation")).alias("k")))))
        .filter((F.col("_upto") - F.col("_n") < F.col("_cut.k")) & (F.col("_cut.k") <= F.col("_upto")))
        .select("_label", "_bucket", F.col("_cut.part").alias("_part"),
                (F.col("_cut.k") - F.col("_upto") + F.col("_n")).alias("_nth"))
    )
    place = F.row_number().over(Window.partitionBy("_label", "_part").orderBy("_hash", "_key"))
    # Two cuts and one pair of ends per class: counted, then broadcast, so no row moves by its label. Only the rows of cut buckets are ranked.
    ends = (
        keyed.join(broadcast_if_small(cuts, MAX_CUTS), ["_label", "_bucket"]).withColumn("_place", place)
        .filter(F.col("_place") == F.col("_nth")).groupBy("_label")
        .agg(*[F.max(F.when(F.col("_part") == p, F.struct("_hash", "_key"))).alias(f"_{p}")
               for p in (TEST, VALIDATION)])
    )
    return (tagged.join(broadcast_if_small(ends, MAX_CUTS), "_label", "left")
            .withColumn(name, _label(tagged, key, seed, F.col(f"_{TEST}"), F.col(f"_{VALIDATION}")))
            .drop("_label", f"_{TEST}", f"_{VALIDATION}"))


def split_hash(df: DataFrame, test_size: float = 0.2, validation_size: float = 0.0, seed: int = 42,
               key: str = "row_id", name: str = "split") -> DataFrame:
    """Approximate sizes from the hash alone: a projection that stays stable as data grows."""
    check_sizes(test_size, validation_size)
    place = seeded_order(key, seed) % 10000
    return df.withColumn(name, F.when(place < round(test_size * 10000), TEST).when(
        place < round((test_size + validation_size) * 10000), VALIDATION).otherwise(TRAIN))


def split_distribution(df: DataFrame, category: str = "category", split: str = "split") -> DataFrame:
    return df.groupBy(split, category).agg(F.count(F.lit(1)).alias("n"))
