"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.words import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of the edges ``(a long, b long)``; a component is its smallest node.

    Alternates two steps until every node has one edge at most to a smaller node, and that one none: every node ties its larger
    neighbours to its smallest one, then its smaller ones. Neither step changes such stars. Both reduce with grouped minima (merged before the shuffle) and keep at most the number of edges, so a
    node with very many edges costs no pairs. Rounds grow with the logarithm of the longest path. Self edges and
    repeated edges are allowed; nulls are ignored. An empty table gives an empty result.
    """
    links = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct())
        large, old = stored(large, "links"), links
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        links = stored(small, "links")
        discard(old)
        discard(large)
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        unfinished = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
        if not unfinished.agg(F.count("*")).first()[0]:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
