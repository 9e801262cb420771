"""Running a plan of tests into findings: every test of a kind in one job, joined back to the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import p_chi2
from . import correlate, cube, groups, regress
from .adjust import ALPHA, family_adjust

COLUMNS = ["family", "dv", "iv", "test", "n", "statistic", "df", "p", "effect_name", "effect"]
LEAST_PAIRED = 5


def _found(results: DataFrame, family: str, test: str, dv: str, iv: str | None, statistic: str, df: list[Column], p: str, effect_name: str, effect: str | None) -> DataFrame:
    degrees = F.array(*[d.cast("double") for d in df]) if df else F.lit(None).cast("array<double>")
    return results.select(
        F.lit(family).alias("family"), F.col(dv).alias("dv"), (F.col(iv) if iv else F.lit(None).cast("string")).alias("iv"), F.lit(test).alias("test"), F.col("n").cast("long").alias("n"), F.col(statistic).cast("double").alias("statistic"),
        degrees.alias("df"), F.col(p).cast("double").alias("p"), F.lit(effect_name).alias("effect_name"), (F.col(effect) if effect else F.lit(None)).cast("double").alias("effect"),
    )


def group_results(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """The five group tests of every pair of columns."""
    long = groups.pairs_long(df, categories, numbers)
    moments, sums = groups.group_moments(long), groups.rank_sums(long)
    two, many = groups.two_groups_p(groups.two_groups(moments)), groups.anova_p(groups.anova(moments))
    ranks = groups.kruskal(sums).withColumn("df", F.col("k") - 1)
    ranks = ranks.withColumn("p", p_chi2(F.col("h"), F.col("df")))
    own = lambda t, test, *rest: _found(t, "group", test, "number", "category", *rest)
    parts = [
        own(two, "student_t", "t", [F.col("df")], "p", "d", "cohen_d"), own(two, "welch_t", "welch_t", [F.col("welch_df")], "welch_p", "d", "cohen_d"),
        own(many, "anova", "f", [F.col("df1"), F.col("df2")], "p", "η²", "eta2"), own(groups.mann_whitney_p(sums), "mann_whitney", "u", [], "p", "r_rb", "rank_biserial"),
        own(ranks, "kruskal_wallis", "h", [F.col("df")], "p", "ε²", "epsilon2"),
    ]
    return reduce(DataFrame.unionByName, parts)


def correlation_results(df: DataFrame, numbers: list[str]) -> DataFrame:
    """Pearson and Spearman of every pair, from five rows; both orders of a pair are there, as a plan may name either."""
    p = correlate.with_p(correlate.pearson_pairs(df, numbers)).where(F.col("n") >= LEAST_PAIRED)
    s = correlate.with_p(correlate.spearman_pairs(df, numbers), "rho").where(F.col("n") >= LEAST_PAIRED)
    parts = []
    for t, test, name, letter in ((p, "pearson", "r", "r"), (s, "spearman", "rho", "ρ")):
        for a, b in (("a", "b"), ("b", "a")):
            parts.append(_found(t, "correlation", test, a, b, name, [F.col("n") - 2], "p", letter, name))
    return reduce(DataFrame.unionByName, parts)


def association_results(df: DataFrame, categories: list[str]) -> DataFrame | None:
    """Chi-square and Fisher of every pair of categories, from one cube of counts; both orders of a pair are there, as a plan names them by place."""
    if len(categories) < 2:
        return None
    t = cube.association_pairs(df, categories)
    parts = []
    for a, b in (("a", "b"), ("b", "a")):  # all figures are the same for the transposed table
        parts.append(_found(t.where("statistic is not null"), "association", "chi_square", a, b, "statistic", [F.col("df")], "p", "V", "cramer_v"))
        parts.append(_found(t.where("fisher_p is not null"), "association", "fisher", a, b, "odds_ratio", [], "fisher_p", "", None))
    return reduce(DataFrame.unionByName, parts)


def regression_results(df: DataFrame, dv: str, predictors: list[str]) -> DataFrame:
    """The planned model of one marked variable; it takes ten rows more than predictors."""
    models = regress.ols_all(df, [dv, *predictors], [dv], least_rows=len(predictors) + 10).limit(1)  # a row per predictor says the same of the model
    return _found(models, "regression", "linear_regression", "dependent", None, "f", [F.lit(len(predictors)), F.col("n") - len(predictors) - 1], "f_p", "R²", "r2")


def run_plan(df: DataFrame, plans: DataFrame, method: str = "holm", alpha: float = ALPHA) -> DataFrame:
    """Findings F1, F2, ... in the order of the plan: id, family, dv, iv, test, n, statistic, df, p, effect_name, effect, error, p_adjusted, significant.

    The plan has a row per test; its names reach the driver, which starts one job for each kind of test. A test without a result keeps an error.
    """
    rows = plans.select("family", "dv", "iv", "extra", "number").collect()
    names = lambda family, side: sorted({r[side] for r in rows if r["family"] == family and r[side]})
    parts = []
    if names("group", "dv"):
        parts.append(group_results(df, names("group", "dv"), names("group", "iv")))
    if measured := sorted({*names("correlation", "dv"), *names("correlation", "iv")}):
        parts.append(correlation_results(df, measured))
    if levels := sorted({*names("association", "dv"), *names("association", "iv")}):
        parts.append(association_results(df, levels))
    parts += [regression_results(df, r["dv"], list(r["extra"])) for r in rows if r["family"] == "regression"]
    own = plans.select(F.concat(F.lit("F"), F.col("number")).alias("id"), "number", *COLUMNS[:4])
    if not parts:
        return own.drop("number").limit(0)
    results = reduce(DataFrame.unionByName, parts)
    key = lambda c: F.coalesce(c, F.lit(""))
    r = results.select(*[F.col(c).alias(f"_{c}") for c in COLUMNS[:4]], *COLUMNS[4:])
    same = (F.col("family") == F.col("_family")) & (F.col("dv") == F.col("_dv")) & (key(F.col("iv")) == key(F.col("_iv"))) & (F.col("test") == F.col("_test"))
    joined = own.join(r, same, "left").select("id", *COLUMNS, F.when(F.col("p").isNull(), "no result: too few rows or nothing varies").alias("error"))
    return significant(family_adjust(joined, method), alpha)


def significant(findings: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The final verdict: the adjusted p, or the raw one without it, below ``alpha``, and no error."""
    p = F.coalesce("p_adjusted", "p")
    return findings.withColumn("significant", F.coalesce((p < alpha) & F.col("error").isNull(), F.lit(False)))


def post_hoc(df: DataFrame, findings: DataFrame, alpha: float = 0.05) -> DataFrame:
    """dv, iv, method, a, b, p: pairwise comparisons behind the findings of three groups and more with a p below ``alpha``."""
    hits = findings.where((F.col("family") == "group") & F.col("test").isin("anova", "kruskal_wallis") & (F.col("p") < alpha)).select("dv", "iv", "test")
    pairs = hits.collect()  # a row per test of the plan
    if not pairs:
        return findings.sparkSession.createDataFrame([], "dv string, iv string, method string, a string, b string, p double")
    long = groups.pairs_long(df, sorted({r["iv"] for r in pairs}), sorted({r["dv"] for r in pairs}))
    t = groups.tukey(groups.group_moments(long)).select(F.col("number").alias("dv"), F.col("category").alias("iv"), F.lit("anova").alias("test"), F.lit("tukey").alias("method"), "a", "b", "p")
    m = groups.pairwise_mann_whitney(long)
    own = Window.partitionBy("category", "number")
    i = F.row_number().over(own.orderBy("p"))
    step = m.withColumn("_s", F.least(F.lit(1.0), F.col("p") * (F.count("*").over(own) - i + 1))).withColumn("_i", i)
    holm = step.withColumn("p", F.max("_s").over(own.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    w = holm.select(F.col("number").alias("dv"), F.col("category").alias("iv"), F.lit("kruskal_wallis").alias("test"), F.lit("mann_whitney_holm").alias("method"), "a", "b", "p")
    return t.unionByName(w).join(F.broadcast(hits), ["dv", "iv", "test"]).drop("test")
