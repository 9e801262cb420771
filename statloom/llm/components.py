"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inputs import discard, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b. Minima are partial aggregates; the join's hot nodes are left to AQE."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        found = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        found = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b) that isn't the smallest itself.

    Each round is written to the shared folder, in place of the one before; a round that changes nothing ends it. Rounds grow with the logarithm of the
    longest path.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    while before[0]:
        last, edges = edges, written(_stars(_stars(edges, True), False), "links")
        discard(last)
        if (now := print_of(edges)) == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
