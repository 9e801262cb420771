"""Categorical against categorical: tables, chi-square, Fisher, agreement and McNemar."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.special import p_chi2


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n for all pairs of levels, zero cells included (levels meet levels only)."""
    known = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null")
    counts = known.groupBy("a", "b").agg(F.count("*").alias("n"))
    frame = counts.select("a").distinct().join(counts.select("b").distinct(), how="cross")
    return frame.join(counts, ["a", "b"], "left").fillna(0, ["n"])


def chi_square(table: DataFrame) -> DataFrame:
    """One row: n, n_rows, n_columns, statistic (Yates on 2x2), df, cramer_v, low_expected."""
    row, column = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    cells = table.select("a", "b", "n", row.alias("r"), column.alias("c"))
    t = cells.agg(F.sum("n").alias("n_all"), F.count_distinct("a").alias("n_rows"), F.count_distinct("b").alias("n_columns"))
    e = F.col("r") * F.col("c") / F.col("n_all")
    yates = F.when((F.col("n_rows") == 2) & (F.col("n_columns") == 2), F.least(F.lit(0.5), F.abs(F.col("n") - e))).otherwise(F.lit(0.0))
    s = cells.join(F.broadcast(t)).groupBy("n_all", "n_rows", "n_columns").agg(F.sum((F.abs(F.col("n") - e) - yates) ** 2 / e).alias("statistic"), F.count_if(e < 5).alias("low_expected"))
    least = F.least("n_rows", "n_columns") - 1
    return s.select(F.col("n_all").alias("n"), "n_rows", "n_columns", "statistic", ((F.col("n_rows") - 1) * (F.col("n_columns") - 1)).alias("df"), F.sqrt(F.try_divide("statistic", F.col("n_all") * least)).alias("cramer_v"), "low_expected")


def least_expected(table: DataFrame) -> DataFrame:
    """One row: n, n_rows, n_columns, least_expected (the smallest expected count)."""
    row, column = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    t = table.select("a", "b", "n", row.alias("r"), column.alias("c")).agg(F.sum("n").alias("n"), F.count_distinct("a").alias("n_rows"), F.count_distinct("b").alias("n_columns"), F.min(F.col("r").cast("double") * F.col("c")).alias("_least"))
    return t.select("n", "n_rows", "n_columns", F.try_divide("_least", "n").alias("least_expected"))


def chi_square_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", p_chi2(F.col("statistic"), F.col("df")))


def two_by_two(table: DataFrame) -> DataFrame:
    """n11, n12, n21, n22 of a 2x2 table, levels by name; no row for other shapes."""
    cells = table.agg(F.array_sort(F.collect_list(F.struct("a", "b", "n"))).alias("t"), F.count_distinct("a").alias("k"), F.count_distinct("b").alias("m")).where("k = 2 and m = 2")  # levels x levels rows
    return cells.select(*[F.col("t")[i]["n"].alias(n) for i, n in enumerate(("n11", "n12", "n21", "n22"))])


@F.pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    def one(a, b, c, d):
        r, s, k = a + b, c + d, a + c
        log = lambda x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(s + 1) - math.lgamma(k - x + 1) - math.lgamma(s - k + x + 1)
        whole = math.lgamma(r + s + 1) - math.lgamma(k + 1) - math.lgamma(r + s - k + 1)
        own = log(a)
        return min(1.0, sum(math.exp(v - whole) for x in range(max(0, k - s), min(r, k) + 1) if (v := log(x)) <= own + 1e-7))

    return pd.Series([one(*map(int, x)) for x in zip(a, b, c, d, strict=True)])


def fisher_exact(table: DataFrame) -> DataFrame:
    """The two-sided p and the sample odds ratio of a 2x2 table."""
    t = two_by_two(table)
    return t.select("*", F.try_divide(F.col("n11") * F.col("n22"), F.col("n12") * F.col("n21")).cast("double").alias("odds_ratio"), _fisher("n11", "n12", "n21", "n22").alias("p"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed, expected, kappa, weighted_kappa (linear, levels by name); none unless both columns have the same levels and ten common rows."""
    from .cube import agreement_pairs

    own = df.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return agreement_pairs(own, ["a", "b"]).where("reason is null").select("n", "observed", "expected", "kappa", "weighted_kappa")


def label_kappa(k: Column) -> Column:
    return F.when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost perfect")


def mcnemar(table: DataFrame) -> DataFrame:
    """discordant_a, discordant_b, statistic (continuity corrected), exact_p where fewer than 25 pairs disagree."""
    t = two_by_two(table)
    b, c = F.col("n12"), F.col("n21")
    n, least = b + c, F.least(b, c)
    choose = F.aggregate(F.sequence(F.lit(0).cast("long"), least), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), lambda s, k: F.struct((s["term"] * (n - k) / (k + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")))["sum"]
    exact = F.when(n < 25, F.least(F.lit(1.0), 2 * choose / F.pow(F.lit(2.0), n)))
    return t.select(b.alias("discordant_a"), c.alias("discordant_b"), F.try_divide((F.greatest(F.abs(b - c) - 1, F.lit(0))) ** 2, n).alias("statistic"), exact.alias("exact_p"))


def label_chi_square(low: Column, n_rows: Column, n_columns: Column) -> Column:
    """Whether chi-square can be trusted, from the number of cells with an expected count below five."""
    exact = F.when((n_rows == 2) & (n_columns == 2), "; see Fisher's p").otherwise("")
    return F.when(low == 0, "yes").otherwise(F.concat(F.lit("careful: expected counts below 5"), exact))
