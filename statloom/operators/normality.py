"""Tests of normality: Shapiro-Wilk for small groups, Lilliefors and Anderson-Darling from ranks, the dispatcher and its verdicts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import norm_quantile, norm_sf, p_chi2
from .describe import long_form, moment_tests_of
from .ranks import mid_ranks

#: Fixed limits: rows up to which Shapiro-Wilk is used, and the least rows of each test.
MOST_SHAPIRO, LEAST_SHAPIRO, LEAST_LILLIEFORS, LEAST_ANDERSON = 5000, 3, 4, 8


def _weights(n: int) -> np.ndarray:
    """Royston's (1995) approximate weights of the order statistics."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = norm_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    square, u = float(m @ m), 1 / math.sqrt(n)
    # fixed values: the published polynomials
    last = m[-1] / math.sqrt(square) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
    a = m.copy()
    if n > 5:
        second = m[-2] / math.sqrt(square) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
        a /= math.sqrt((square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a[1], a[-2] = -second, second
    else:
        a /= math.sqrt((square - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[0], a[-1] = -last, last
    return a


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and p of one bounded sample that varies."""
    n, x = len(x), np.sort(x)
    around = x - x.mean()
    w = min(1.0, float(_weights(n) @ around) ** 2 / float(around @ around))
    if n == 3:
        return w, min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w == 1:
        return w, 1.0
    # fixed values: the published polynomials
    if n <= 11:
        gap = -2.273 + 0.459 * n - math.log(1 - w)
        if gap <= 0:
            return w, 0.0
        y, mean, sd = -math.log(gap), np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, log = math.log(1 - w), math.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log))
    return w, float(norm_sf((y - mean) / sd))


def shapiro_wilk(long: DataFrame, keys: list[str], most: int = MOST_SHAPIRO) -> DataFrame:
    """keys, n, w, p of each group of 3 to ``most`` values that vary; larger groups never reach a task."""
    sizes = long.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    fit = sizes.where(F.col("n").between(LEAST_SHAPIRO, most) & (F.col("_low") < F.col("_high"))).select(*keys)

    def work(group: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro(group["value"].to_numpy(float))
        return group[keys].head(1).assign(n=len(group), w=w, p=p)

    named = ", ".join(f"`{c}` {t}" for c, t in long.select(*keys).dtypes)
    # a row per group; by key, all rows of a large group would meet in one task before they are left out
    return long.where("value is not null").join(F.broadcast(fit), keys, "left_semi").groupBy(*keys).applyInPandas(work, f"{named}, n long, w double, p double")


def _tails(z: pd.Series) -> pd.DataFrame:
    v = z.to_numpy(float)
    below, above = norm_sf(-v), norm_sf(v)
    return pd.DataFrame({"below": below, "log_below": np.log(np.maximum(below, 1e-300)), "log_above": np.log(np.maximum(above, 1e-300))})


def _normal(z: Column) -> Column:
    return F.pandas_udf(_tails, "struct<below double, log_below double, log_above double>")(z)


def _lilliefors_p(d: Column, n: Column) -> Column:
    """Dallal and Wilkinson's formula up to 0.1, Stephens' modified statistic above it (fixed values)."""
    far, m = F.when(n > 100, d * F.pow(n / 100, 0.49)).otherwise(d), F.least(n.cast("double"), F.lit(100.0))
    small = F.exp(-7.01256 * far**2 * (m + 2.78019) + 2.99587 * far * F.sqrt(m + 2.78019) - 0.122119 + 0.974598 / F.sqrt(m) + 1.67997 / m)
    k = (F.sqrt(n) - 0.01 + 0.85 / F.sqrt(n)) * d
    poly = lambda *c: sum((x * k**i for i, x in enumerate(c[1:], 1)), F.lit(c[0]))
    large = (
        F.when(k <= 0.302, F.lit(1.0)).when(k <= 0.5, poly(2.76773, -19.828315, 80.709644, -138.55152, 81.218052))
        .when(k <= 0.9, poly(-4.901232, 40.662806, -97.490286, 94.029866, -32.355711)).when(k <= 1.31, poly(6.198765, -19.558097, 23.186922, -12.234627, 2.423045)).otherwise(F.lit(0.0))
    )
    return F.when(small <= 0.1, small).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), large)))


def _anderson_p(a2: Column, n: Column) -> Column:
    """Stephens' formula for unknown mean and variance (fixed values)."""
    a = a2 * (1 + 0.75 / n + 2.25 / n**2)
    return (
        F.when(a < 0.2, 1 - F.exp(-13.436 + 101.14 * a - 223.73 * a**2)).when(a < 0.34, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a**2))
        .when(a < 0.6, F.exp(0.9177 - 4.279 * a - 1.38 * a**2)).when(a < 10, F.exp(1.2937 - 5.709 * a + 0.0186 * a**2)).otherwise(F.lit(0.0))
    )


def distribution_tests(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, lilliefors_d, lilliefors_p, anderson_a2, anderson_p of each group that varies.

    Equal values share one row with their first and last place, so both statistics are sums or maxima over distinct values.
    """
    m = long.groupBy(*keys).agg(F.count("value").alias("total"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).where("sd > 0")
    placed = mid_ranks(long, keys, "value").drop("total").join(F.broadcast(m), keys)  # a row per group
    first, last, total = F.col("rank") - (F.col("n") - 1) / 2, F.col("rank") + (F.col("n") - 1) / 2, F.col("total")
    z = placed.select(*keys, "total", first.alias("f"), last.alias("l"), _normal((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))
    f, l, below = F.col("f"), F.col("l"), F.col("z.below")  # noqa: E741
    parts = (l**2 - (f - 1) ** 2) * F.col("z.log_below") + ((total - f + 1) ** 2 - (total - l) ** 2) * F.col("z.log_above")
    s = z.groupBy(*keys, "total").agg(F.max(F.greatest(l / total - below, below - (f - 1) / total)).alias("d"), F.sum(parts).alias("s"))
    d, n, a2 = F.col("d"), F.col("total"), -F.col("total") - F.col("s") / F.col("total")
    return s.select(
        *keys, n.alias("n"), F.when(n >= LEAST_LILLIEFORS, d).alias("lilliefors_d"), F.when(n >= LEAST_LILLIEFORS, _lilliefors_p(d, n)).alias("lilliefors_p"),
        F.when(n >= LEAST_ANDERSON, a2).alias("anderson_a2"), F.when(n >= LEAST_ANDERSON, _anderson_p(a2, n)).alias("anderson_p"),
    )


def normality(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """variable, test, n, statistic, p, normal: Shapiro-Wilk up to 5,000 values and D'Agostino's K2 above."""
    return normality_of(long_form(df, columns), ["variable"]).withColumn("normal", F.col("p") >= alpha)


def normality_of(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, test, n, statistic, p for each group of a long table."""
    small = shapiro_wilk(long, keys).select(*keys, F.lit("shapiro_wilk").alias("test"), "n", F.col("w").alias("statistic"), "p")
    large = moment_tests_of(long, keys).where(F.col("n") > MOST_SHAPIRO)
    return small.unionByName(large.select(*keys, F.lit("dagostino_k2").alias("test"), "n", F.col("k2").alias("statistic"), p_chi2(F.col("k2"), F.lit(2)).alias("p")))


def verdict(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNull(), "unknown").when(p >= alpha, "yes").otherwise("no")


def balanced_normality(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, normal: the balanced verdict on each group with a known value. A group that doesn't vary isn't normal."""
    sizes = long.where("value is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.skewness("value").alias("_skew"), F.kurtosis("value").alias("_kurt"), (F.min("value") < F.max("value")).alias("_varies"))
    j = sizes.join(shapiro_wilk(long, keys).select(*keys, F.col("p").alias("_p")), keys, "left")
    verdict = F.col("_varies") & balanced_verdict(F.col("n"), F.col("_skew"), F.col("_kurt"), F.col("_p"))
    return j.select(*keys, "n", F.coalesce(verdict, F.lit(False)).alias("normal"))


def balanced_verdict(n: Column, skew: Column, kurt: Column, p: Column) -> Column:
    """The lenient verdict: shape counts beside the test, and more so in samples over 50."""
    loose, mild = (F.abs(skew) < 2) & (F.abs(kurt) < 7), (F.abs(skew) < 1) & (F.abs(kurt) < 3)
    return F.when(n < 3, F.lit(False)).when(p.isNull(), mild).when(n <= 50, (p > 0.05) & loose).otherwise(mild | ((p > 0.05) & loose))
