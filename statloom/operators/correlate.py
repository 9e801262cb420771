"""Numeric against numeric: Pearson, Spearman, Kendall, simple and partial regression measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import p_t, p_z
from ..session import work_table
from .describe import as_number
from .moments import covariance, pair_moments
from .ranks import concordance, mid_ranks

REDUNDANT = 0.95


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size < 0.1, "negligible").when(size < 0.3, "weak").when(size < 0.5, "moderate").when(size < 0.7, "strong").otherwise("very strong")


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, r, ci_low, ci_high, slope, intercept, strength for each pair with four rows and variation."""
    m = pair_moments(df, columns).where("n >= 4 and var_a > 0 and var_b > 0")
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.sqrt(F.col("var_a") * F.col("var_b"))))
    z, half = 0.5 * F.log((1 + F.col("r")) / (1 - F.col("r"))), 1.96 / F.sqrt(F.col("n") - 3)
    limits = lambda v: F.when(F.abs("r") < 1, F.tanh(v))
    slope = F.col("cov") / F.col("var_a")
    return m.withColumn("r", r).select("a", "b", "n", "r", limits(z - half).alias("ci_low"), limits(z + half).alias("ci_high"), slope.alias("slope"), (F.col("mean_b") - slope * F.col("mean_a")).alias("intercept"), strength(F.col("r")).alias("strength"))


def with_p(pairs: DataFrame, r: str = "r") -> DataFrame:
    t = F.col(r) * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col(r) ** 2, F.lit(1e-300)))
    return pairs.withColumn("p", p_t(t, F.col("n") - 2))


def redundant_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.abs("r") >= REDUNDANT).orderBy(F.abs("r").desc(), "a", "b")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and rho. Ranks are taken after pairwise deletion, over distinct values, and meet the cells of equal (x, y)."""
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    rank_x = mid_ranks(known, [], "x").select("x", F.col("rank").alias("rx"))
    rank_y = mid_ranks(known, [], "y").select("y", F.col("rank").alias("ry"))
    cells = known.groupBy("x", "y").agg(F.count("*").alias("n")).join(rank_x, "x").join(rank_y, "y")
    n, mid = F.sum("n"), None
    s = cells.agg(n.alias("n"), F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("xy"), F.sum(F.col("n") * F.col("rx") ** 2).alias("xx"), F.sum(F.col("n") * F.col("ry") ** 2).alias("yy"))
    centre = F.col("n") * ((F.col("n") + 1) / 2) ** 2
    return s.select("n", F.try_divide(F.col("xy") - centre, F.sqrt((F.col("xx") - centre) * (F.col("yy") - centre))).alias("rho"))


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, rho for every pair of columns in one job: rows are counted per pair and cell, and ranked within their pair after pairwise deletion."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    spark = df.sparkSession
    # equal rows are counted before they are copied to the pairs, and the cells of the pairs once for all that follows
    own = df.select([as_number(df, c).alias(c) for c in columns]).groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("_m"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y"), F.col("_m").alias("m")) for i, (a, b) in enumerate(pairs)]))
    cells = work_table(own.select(each.alias("p")).select("p.*").where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("pair", "x", "y").agg(F.sum("m").alias("m")), "cells")
    rank = lambda v, name: mid_ranks(cells, ["pair"], v, weight="m").select("pair", v, F.col("rank").alias(name))
    j = cells.join(rank("x", "rx"), ["pair", "x"]).join(rank("y", "ry"), ["pair", "y"])
    named = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    s = j.groupBy("pair").agg(F.sum("m").alias("n"), *[F.sum(F.col("m") * F.col(p) * F.col(q)).alias(p + q) for p, q in (("rx", "ry"), ("rx", "rx"), ("ry", "ry"))])
    centre = F.col("n") * ((F.col("n") + 1) / 2) ** 2
    rho = F.try_divide(F.col("rxry") - centre, F.sqrt((F.col("rxrx") - centre) * (F.col("ryry") - centre)))
    return s.where("n >= 4").join(F.broadcast(named), "pair").select("a", "b", "n", rho.alias("rho"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, s and tau_b."""
    c = concordance(df, x, y)
    total = F.col("n") * (F.col("n") - 1) / 2
    return c.select("n", "s", F.try_divide(F.col("s"), F.sqrt((total - F.col("tx")) * (total - F.col("ty")))).alias("tau_b"))


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = (F.when(~F.isnan(v), v) for v in (F.col(y).cast("double"), F.col(x).cast("double")))
    return df.agg(F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))


def partial_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, r, partial, flag: each pair given all other columns, over complete rows. A matrix of columns x columns reaches the driver."""
    spark = df.sparkSession
    schema = "a string, b string, n long, r double, partial double, flag string"
    n, _, cov = covariance(df, columns)
    k = len(columns)
    if k < 3 or n < max(25, k + 5) or (np.diag(cov) <= 0).any():
        return spark.createDataFrame([], schema)
    sd = np.sqrt(np.diag(cov))
    r = cov / np.outer(sd, sd)
    p = np.linalg.pinv(r)
    rows = []
    for i in range(k):
        for j in range(i + 1, k):
            part = float(np.clip(-p[i, j] / np.sqrt(p[i, i] * p[j, j]), -1, 1))
            drop = abs(r[i, j]) - abs(part)
            flag = "spurious" if abs(r[i, j]) >= 0.3 and drop >= 0.2 else "suppressed" if drop <= -0.2 else None
            rows.append((columns[i], columns[j], n, float(r[i, j]), part, flag))
    return spark.createDataFrame(rows, schema)


def kendall_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, s, tau_b, z and p by the normal form, its variance corrected for ties; z and p are null with fewer than three rows or one value."""
    c, n = concordance(df, x, y), F.col("n").cast("double")
    m = n * (n - 1)
    variance = (m * (2 * n + 5) - F.col("vx") - F.col("vy")) / 18 + F.try_divide(2 * F.col("tx") * F.col("ty"), m) + F.try_divide(F.col("ux") * F.col("uy"), 9 * m * (n - 2))
    tau = F.try_divide(F.col("s"), F.sqrt((m / 2 - F.col("tx")) * (m / 2 - F.col("ty"))))
    z = F.when((n > 2) & (variance > 0), F.try_divide(F.col("s"), F.sqrt(variance)))
    return c.select("n", "s", tau.alias("tau_b"), z.alias("z")).withColumn("p", p_z(F.col("z")))
