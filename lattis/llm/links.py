"""Connected components of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.work import stash


def components(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id of its component) for every id in edges (a, b). No step holds a component in one
    task: a vertex's smallest neighbour is aggregated before the shuffle and written out, so that the join with its
    neighbours is one between two plain tables, whose hot keys Spark splits."""
    links = stash(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # large star: each larger neighbour of a vertex is linked to the smallest one
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        low = stash(low, "lows")
        large = both.join(low, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stash(large.filter("a <> b").distinct(), "links")
        # small star: the smaller neighbours of a vertex, and itself, are linked to the smallest one
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"), "lows")
        small = large.join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
        after = stash(small.filter("a <> b").distinct(), "links")
        # converged once every vertex has one link at most, to a vertex that has none
        ends = after.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(after.select(F.col("b").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        ends = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        if not (ends.agg(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0)))).first() or [False])[0]:
            break
        links = after
    return after.select(F.col("a").alias("id"), F.col("b").alias("root")).union(after.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
