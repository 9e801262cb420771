"""The common table of significant findings over the result tables of several analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .adjust import ALPHA, adjust_p


def as_findings(results: DataFrame, analysis: str, first: str, second: str, effect: str) -> DataFrame:
    """analysis, first, second, effect_name, effect, p and its corrections within this table; the columns are named by the caller."""
    own = results.select(F.lit(analysis).alias("analysis"), F.col(first).alias("first"), F.col(second).alias("second"), F.lit(effect).alias("effect_name"), F.col(effect).cast("double").alias("effect"), "p")
    return adjust_p(own, family=["analysis"])


def skipped_tests(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """family, test, reason: what all families left out, from their tables with a ``reason``; the columns named with a table are the variables of its tests."""
    parts = [df.where("reason is not null").select(F.lit(family).alias("family"), F.concat_ws(" × ", *[F.col(c) for c in names]).alias("test"), "reason") for family, (df, names) in tables.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("family", "test")


def significant_findings(tables: list[DataFrame], alpha: float = ALPHA) -> DataFrame:
    """Findings below ``alpha`` after the false discovery correction, by that p and names; each input has a row per test."""
    together = reduce(DataFrame.unionByName, tables)
    return together.where(F.col("p_bh") < alpha).orderBy("p_bh", "p", "analysis", "first", "second")


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, n_columns, n_cells of each result table, counted in one job."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), (F.col("n_rows") * len(df.columns)).alias("n_cells")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


#: Fixed factors of the work estimate: trees and nodes of a model, repeats of the permutation, and rounds of the clustering.
TREES, NODES, REPEATS, CLUSTER_TRIES, CLUSTER_ROUNDS, MOST_DIMENSIONS = 100, 32, 5, 5, 50, 10


def work_estimate(n_rows: int, n_numbers: int, n_categories: int, n_models: int, clustered: bool) -> int:
    """About how many elementary steps the discovery layer takes."""
    import math

    pairs = n_numbers * (n_numbers - 1) // 2
    steps = pairs * int(n_rows * max(1.0, math.log2(n_rows))) if n_rows > 1 else 0
    steps += n_models * (TREES * NODES * n_rows + REPEATS * max(1, n_numbers + n_categories - 1) * n_rows)
    steps += CLUSTER_TRIES * CLUSTER_ROUNDS * n_rows * min(n_numbers, MOST_DIMENSIONS) if clustered else 0
    return steps + TREES * n_rows + n_numbers**3


def highlights(tables: dict[str, tuple[DataFrame, str, int, str]]) -> DataFrame:
    """kind, rank, text: the leading rows of each table, as (table, column to order by, how many, SQL expression of the text)."""
    parts = []
    for kind, (df, by, most, text) in tables.items():
        best = df.select(F.expr(text).alias("text"), F.col(by).alias("_by")).orderBy(F.col("_by").desc(), "text").limit(most)
        parts.append(best.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(F.col("_by").desc(), "text")).alias("rank"), "text"))  # ``most`` rows
    return reduce(DataFrame.unionByName, parts)
