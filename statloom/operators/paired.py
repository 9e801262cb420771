"""Paired and repeated measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import p_chi2, p_t, p_wilcoxon_exact, p_z
from ..session import work_table
from .adjust import adjust_p
from .describe import as_number, moment_statistics
from .moments import pair_moments
from .normality import MOST_SHAPIRO, shapiro_wilk
from .ranks import mid_ranks, quantiles

EXACT_PAIRS = 50


def paired_t(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, difference, sd, t, df, d_z for each pair of columns, from the Gram pass."""
    m = pair_moments(df, columns).withColumn("var", F.col("var_a") + F.col("var_b") - 2 * F.col("cov")).where("n >= 5 and var > 0")
    d, sd = F.col("mean_a") - F.col("mean_b"), F.sqrt("var")
    return m.select("a", "b", "n", d.alias("difference"), sd.alias("sd"), (d / (sd / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"), (d / sd).alias("d_z"))


def paired_t_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", p_t(F.col("t"), F.col("df")))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n (differences other than zero), w_plus, w_minus, w, z (tie corrected)."""
    d = df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).where("d is not null and not isnan(d) and d <> 0").select(F.abs("d").alias("size"), (F.col("d") > 0).alias("up"))
    ranks = mid_ranks(d.select("size"), [], "size")
    cells = d.groupBy("size", "up").agg(F.count("*").alias("m")).join(ranks.select("size", "rank", F.col("n").alias("tied")), "size")
    up = F.when(F.col("up"), F.col("m") * F.col("rank")).otherwise(0.0)
    t = cells.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(up), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("m") * F.col("rank") - up), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(F.col("m") * (F.col("tied") ** 2 - 1.0)), F.lit(0.0)).alias("ties"))
    n = F.col("n").cast("double")
    w = F.least("w_plus", "w_minus")
    return t.select("n", "w_plus", "w_minus", w.alias("w"), F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)).alias("z"), "ties")


def wilcoxon_p(t: DataFrame) -> DataFrame:
    """p: exact up to 50 differences without ties, else by the normal distribution."""
    exact = (F.col("ties") == 0) & (F.col("n") <= EXACT_PAIRS)
    only = lambda c: F.when(exact, F.col(c).cast("double"))
    return t.withColumn("p", F.coalesce(p_wilcoxon_exact(only("n"), only("w")), p_z(F.col("z"))))


LEAST_PAIRS, ALPHA = 5, 0.05


def paired_tests(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, difference, sd, median_difference, normal, t, t_p, w, w_p, d_z, recommended, p with its corrections, reason, for every pair of columns.

    All pairs share their passes. The t test is recommended where the differences pass the test of normality, else signed ranks. Pairs with fewer than five
    common rows, or whose differences are all the same, have a reason and no test. Nulls and NaN are missing.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "a string, b string, n long, reason string")
    # equal rows are counted before they are copied to the pairs, and equal differences once for all that follows
    own = df.select([as_number(df, c).alias(c) for c in columns]).groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("_m"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("value"), F.col("_m").alias("m")) for i, (a, b) in enumerate(pairs)]))
    keys, m = ["pair"], F.col("m")
    long = work_table(own.select(each.alias("p")).select("p.*").where("value is not null and not isnan(value)").groupBy("pair", "value").agg(F.sum("m").alias("m")), "differences")
    mean = long.groupBy("pair").agg(F.sum("m").alias("n"), (F.sum(m * F.col("value")) / F.sum("m")).alias("difference"), (F.min("value") < F.max("value")).alias("_varies"))
    away = F.col("value") - F.col("difference")
    basis = long.join(F.broadcast(mean), "pair").groupBy("pair", "n", "difference", "_varies").agg(*[F.sum(m * away**k).alias(f"_m{k}") for k in (2, 3, 4)])  # a row per pair
    basis = basis.withColumn("sd", F.when(F.col("_varies"), F.sqrt(F.try_divide("_m2", F.col("n") - 1))).otherwise(F.lit(0.0)))
    medians = quantiles(long, keys, "value", [0.5], weight="m").select(*keys, F.col("q")[0].alias("median_difference"))
    cells = long.where("value <> 0").select(*keys, F.abs("value").alias("size"), (F.col("value") > 0).alias("up"), "m")
    ranks = mid_ranks(cells, keys, "size", weight="m").select(*keys, "size", "rank", F.col("n").alias("tied"))
    up = F.when(F.col("up"), F.col("m") * F.col("rank")).otherwise(0.0)
    s = cells.join(ranks, [*keys, "size"]).groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(up).alias("plus"), F.sum(F.col("m") * F.col("rank") - up).alias("minus"), F.sum(F.col("m") * (F.col("tied") ** 2 - 1.0)).alias("ties"))
    k, w = F.col("n").cast("double"), F.least("plus", "minus")
    signed = wilcoxon_p(s.select(*keys, "n", w.alias("w"), F.try_divide(w - k * (k + 1) / 4, F.sqrt(k * (k + 1) * (2 * k + 1) / 24 - F.col("ties") / 48)).alias("z"), "ties"))
    few = long.join(F.broadcast(mean.where(F.col("n") <= MOST_SHAPIRO).select("pair")), "pair", "left_semi").select("pair", F.explode(F.array_repeat("value", F.col("m").cast("int"))).alias("value"))
    many = basis.where((F.col("n") > MOST_SHAPIRO) & F.col("_varies"))
    _, z1, z2 = moment_statistics(F.col("n"), F.sqrt(F.col("n")) * F.col("_m3") / F.pow("_m2", F.lit(1.5)), F.col("n") * F.col("_m4") / F.col("_m2") ** 2 - 3)
    shape = shapiro_wilk(few, keys).select(*keys, F.col("p").alias("_normal_p")).unionByName(many.select(*keys, p_chi2(z1**2 + z2**2, F.lit(2)).alias("_normal_p")))
    named = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    t = named.join(basis.select(*keys, "n", "difference", "sd"), keys, "left").join(medians, keys, "left").join(signed.select(*keys, "w", F.col("p").alias("w_p")), keys, "left").join(shape, keys, "left")
    n = F.coalesce("n", F.lit(0))
    reason = F.when(n < LEAST_PAIRS, F.concat(F.lit("n="), n.cast("string"), F.lit(f" < {LEAST_PAIRS}"))).when(F.col("sd") == 0, "all differences are the same")
    t = t.withColumns({"n": n, "reason": reason, "normal": F.coalesce(F.col("_normal_p") >= ALPHA, F.lit(False))})
    fine = F.col("reason").isNull()
    t = t.withColumn("t", F.when(fine, F.col("difference") / (F.col("sd") / F.sqrt("n")))).withColumn("t_p", p_t(F.col("t"), F.when(fine, F.col("n") - 1)))
    only = lambda c: F.when(fine, F.col(c))
    found = t.select(
        "a", "b", "n", only("difference").alias("difference"), only("sd").alias("sd"), only("median_difference").alias("median_difference"), only("normal").alias("normal"), "t", "t_p", only("w").alias("w"), only("w_p").alias("w_p"),
        F.when(fine, F.col("difference") / F.col("sd")).alias("d_z"), F.when(fine, F.when(F.col("normal"), "paired_t").otherwise("wilcoxon")).alias("recommended"), F.when(fine, F.when(F.col("normal"), F.col("t_p")).otherwise(F.col("w_p"))).alias("p"), "reason",
    )
    return adjust_p(found).orderBy("p", "a", "b")


def friedman(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, k, chi2 (tie corrected), kendall_w; each row is ranked inside an array, so nothing is shuffled but sums."""
    k = len(columns)
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select([F.col(c).cast("double") for c in columns]).dropna().select(x.alias("x"))
    rank = F.transform("x", lambda v: F.size(F.filter("x", lambda u: u < v)) + (F.size(F.filter("x", lambda u: u == v)) + 1) / 2)
    ties = F.aggregate(F.transform("x", lambda v: F.size(F.filter("x", lambda u: u == v)).cast("double")), F.lit(0.0), lambda s, t: s + t * t - 1)
    ranked = rows.select(rank.alias("r"), ties.alias("ties"))
    s = ranked.agg(F.count("*").alias("n"), *[F.sum(F.col("r")[i]).alias(f"s{i}") for i in range(k)], F.sum("ties").alias("ties"))
    n = F.col("n").cast("double")
    total = sum((F.col(f"s{i}") ** 2 for i in range(1, k)), F.col("s0") ** 2)
    chi2 = F.try_divide(12 / (n * k * (k + 1)) * total - 3 * n * (k + 1), 1 - F.col("ties") / (n * k * (k * k - 1)))
    return s.where("n >= 10").select("n", F.lit(k).cast("long").alias("k"), chi2.alias("chi2"), (chi2 / (n * (k - 1))).alias("kendall_w"))


def friedman_p(t: DataFrame) -> DataFrame:
    return t.withColumn("p", p_chi2(F.col("chi2"), F.col("k") - 1))
