"""Categorical against numeric: group moments, parametric and rank tests, effect sizes, recommendations, post-hoc tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import p_f, p_mann_whitney_exact, p_t, p_tukey, p_z
from .describe import as_number, clean_numbers
from .ranks import mid_ranks, quantiles

LEAST_GROUP = 3
#: Rank tests count arrangements where the smaller group has so many rows, there are no ties and the product of sizes is bounded.
EXACT_GROUP, EXACT_PRODUCT = 8, 20_000


def pairs_long(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """category, number, grp, value: a row for each known value of each pair of columns."""
    own = clean_numbers(df).select([F.col(c).cast("string").alias(f"c_{c}") for c in categories] + [as_number(df, x).alias(f"x_{x}") for x in numbers])
    groups = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"c_{c}").alias("grp")) for c in categories]))
    values = F.explode(F.array(*[F.struct(F.lit(x).alias("number"), F.col(f"x_{x}").alias("value")) for x in numbers]))
    return own.select(groups.alias("g"), *[f"x_{x}" for x in numbers]).select("g.*", values.alias("v")).select("category", "grp", "v.*").where("grp is not null and value is not null")


def group_moments(long: DataFrame, median: bool = False) -> DataFrame:
    """category, number, grp, n, mean, sd, and the median if asked for; groups under three rows are left out."""
    keys = ["category", "number", "grp"]
    m = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd")).where(F.col("n") >= LEAST_GROUP)
    return m.join(quantiles(long, keys, "value", [0.5]).select(*keys, F.col("q")[0].alias("median")), keys) if median else m


def anova(moments: DataFrame) -> DataFrame:
    """category, number, k, n, f, df1, df2, eta2, welch_f, welch_df2 from group moments alone."""
    keys = ["category", "number"]
    w = F.col("n") / F.nullif(F.col("sd") ** 2, F.lit(0.0))
    t = moments.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum(w).alias("w_all"), (F.sum(w * F.col("mean")) / F.sum(w)).alias("w_mean"),
    ).where("k >= 2")
    j = moments.join(t, keys)
    s = j.groupBy(*keys, "k", "n_all", "w_all").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"), F.sum((F.col("n") - 1) * F.col("sd") ** 2).alias("ssw"),
        F.sum(w * (F.col("mean") - F.col("w_mean")) ** 2).alias("wss"), F.sum((1 - w / F.col("w_all")) ** 2 / (F.col("n") - 1)).alias("lam"),
    )
    k, n = F.col("k"), F.col("n_all")
    return s.select(
        *keys, "k", n.alias("n"), F.try_divide(F.col("ssb") / (k - 1), F.col("ssw") / (n - k)).alias("f"), (k - 1).alias("df1"), (n - k).alias("df2"), F.coalesce(F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")), F.lit(0.0)).alias("eta2"),
        F.try_divide(F.col("wss") / (k - 1), 1 + 2 * (k - 2) / (k**2 - 1) * F.col("lam")).alias("welch_f"), F.try_divide(k**2 - 1, 3 * F.col("lam")).alias("welch_df2"),
    )


def anova_p(tests: DataFrame) -> DataFrame:
    return tests.withColumns({"p": p_f(F.col("f"), F.col("df1"), F.col("df2")), "welch_p": p_f(F.col("welch_f"), F.col("df1"), F.col("welch_df2"))})


def two_groups(moments: DataFrame) -> DataFrame:
    """Student and Welch t, Cohen's d and Hedges' g for pairs of columns with two groups; signs speak of the first group by name."""
    g = F.array_sort(F.collect_list(F.struct("grp", "n", "mean", "sd")))
    t = moments.groupBy("category", "number").agg(g.alias("g")).where(F.size("g") == 2).select("category", "number", F.col("g")[0].alias("a"), F.col("g")[1].alias("b"))
    n1, n2, v1, v2 = F.col("a.n"), F.col("b.n"), F.col("a.sd") ** 2, F.col("b.sd") ** 2
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    diff, se2 = F.col("a.mean") - F.col("b.mean"), v1 / n1 + v2 / n2
    d = F.coalesce(F.try_divide(diff, F.sqrt(pooled)), F.lit(0.0))
    return t.select(
        "category", "number", F.col("a.grp").alias("group_a"), F.col("b.grp").alias("group_b"), (n1 + n2).alias("n"), F.try_divide(diff, F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("t"), (n1 + n2 - 2).alias("df"),
        F.try_divide(diff, F.sqrt(se2)).alias("welch_t"), F.try_divide(se2**2, (v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)).alias("welch_df"), d.alias("cohen_d"), (d * (1 - 3 / (4 * (n1 + n2) - 9))).alias("hedges_g"),
    )


def two_groups_p(tests: DataFrame) -> DataFrame:
    return tests.withColumns({"p": p_t(F.col("t"), F.col("df")), "welch_p": p_t(F.col("welch_t"), F.col("welch_df"))})


def levene(long: DataFrame) -> DataFrame:
    """The median-centred Levene statistic: an analysis of variance of the distances from the group medians."""
    keys = ["category", "number", "grp"]
    medians = group_moments(long, median=True).select(*keys, "median")
    # medians have a row per group; by key, all rows of a group would meet in one task
    distances = long.join(F.broadcast(medians), keys).select(*keys, F.abs(F.col("value") - F.col("median")).alias("value"))
    return anova(group_moments(distances)).select("category", "number", "k", "n", F.col("f").alias("levene"), "df1", "df2")


def rank_sums(long: DataFrame) -> DataFrame:
    """category, number, grp, n, rank_sum, and the tie term of the pair of columns, by mid-ranks over all its groups."""
    keys = ["category", "number"]
    # counted once: sizes, ranks and sums start from the same exchange
    cells = long.groupBy(*keys, "grp", "value").agg(F.count("*").alias("m"))
    sized = cells.groupBy(*keys, "grp").agg(F.sum("m").alias("n")).where(F.col("n") >= LEAST_GROUP).select(*keys, "grp")
    kept = cells.join(F.broadcast(sized), [*keys, "grp"])  # a row per group
    ranks = mid_ranks(kept, keys, "value", weight="m")
    ties = ranks.groupBy(*keys).agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    sums = kept.join(ranks.select(*keys, "value", "rank"), [*keys, "value"]).groupBy(*keys, "grp").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rank")).alias("rank_sum"))
    return sums.join(ties, keys)


def kruskal(sums: DataFrame) -> DataFrame:
    """category, number, k, n, h (tie-corrected), epsilon2."""
    t = sums.groupBy("category", "number", "ties").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("part")).where("k >= 2")
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("part") - 3 * (n + 1), 1 - F.col("ties") / (n**3 - n))
    return t.select("category", "number", "k", "n", h.alias("h"), ((h - F.col("k") + 1) / (n - F.col("k"))).alias("epsilon2"))


def mann_whitney(sums: DataFrame) -> DataFrame:
    """category, number, n, u (of the first group), z (tie and continuity corrected), rank_biserial, for two groups."""
    g = F.array_sort(F.collect_list(F.struct("grp", "n", "rank_sum")))
    t = sums.groupBy("category", "number", "ties").agg(g.alias("g")).where(F.size("g") == 2).select("category", "number", "ties", F.col("g")[0].alias("a"), F.col("g")[1].alias("b"))
    n1, n2 = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    n, u = n1 + n2, F.col("a.rank_sum") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    away = F.abs(u - n1 * n2 / 2)
    z = F.signum(u - n1 * n2 / 2) * F.try_divide(F.greatest(away - 0.5, F.lit(0.0)), sd)
    return t.select("category", "number", n.cast("long").alias("n"), u.alias("u"), z.alias("z"), (1 - 2 * u / (n1 * n2)).alias("rank_biserial"))


def mann_whitney_p(sums: DataFrame) -> DataFrame:
    """Mann-Whitney tests with p: exact for small groups without ties, else by the normal distribution."""
    sizes = sums.groupBy("category", "number", "ties").agg(F.min("n").alias("_least"), F.max("n").alias("_most"), F.count("*").alias("_k")).where("_k = 2").drop("_k")
    tests = mann_whitney(sums).join(sizes, ["category", "number"])
    exact = (F.col("ties") == 0) & (F.col("_least") <= EXACT_GROUP) & (F.col("_least") * F.col("_most") <= EXACT_PRODUCT)
    only = lambda c: F.when(exact, F.col(c).cast("double"))
    # the distribution of U is symmetric, so the order of the groups doesn't matter
    p = F.coalesce(p_mann_whitney_exact(only("_least"), only("_most"), only("u")), p_z(F.col("z")))
    return tests.withColumn("p", p).drop("ties", "_least", "_most")


def pairwise_mann_whitney(long: DataFrame) -> DataFrame:
    """category, number, a, b, n, u, z, p, median_difference for every pair of groups, ranked within the pair.

    Rows are counted per group and value before each count is copied to the pairs of its group.
    """
    keys = ["category", "number"]
    sized = group_moments(long, median=True).select(*keys, "grp", "n", "median")
    x, y = sized.alias("x"), sized.alias("y")
    pairs = x.join(y, (F.col("x.category") == F.col("y.category")) & (F.col("x.number") == F.col("y.number")) & (F.col("x.grp") < F.col("y.grp"))).select(
        F.col("x.category").alias("category"), F.col("x.number").alias("number"), F.col("x.grp").alias("a"), F.col("y.grp").alias("b"), F.col("x.n").alias("n1"), F.col("y.n").alias("n2"), (F.col("x.median") - F.col("y.median")).alias("median_difference"),
    )
    cells = long.groupBy(*keys, "grp", "value").agg(F.count("*").alias("m"))
    members = pairs.select(*keys, "a", "b", F.explode(F.array("a", "b")).alias("grp"))
    dealt = cells.join(members, [*keys, "grp"])  # members have a row per pair of groups and side
    own = [*keys, "a", "b"]
    ranks = mid_ranks(dealt, own, "value", weight="m")
    ties = ranks.groupBy(*own).agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    firsts = dealt.where(F.col("grp") == F.col("a")).join(ranks.select(*own, "value", "rank"), [*own, "value"]).groupBy(*own).agg(F.sum(F.col("m") * F.col("rank")).alias("rank_sum"))
    t = firsts.join(ties, own).join(pairs, own)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("rank_sum") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.signum(u - n1 * n2 / 2) * F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd)
    found = t.select(*own, n.cast("long").alias("n"), u.alias("u"), z.alias("z"), "median_difference", "n1", "n2", "ties")
    exact = (F.col("ties") == 0) & (F.least("n1", "n2") <= EXACT_GROUP) & (F.col("n1") * F.col("n2") <= EXACT_PRODUCT)
    only = lambda c: F.when(exact, F.col(c).cast("double"))
    return found.withColumn("p", F.coalesce(p_mann_whitney_exact(only("n1"), only("n2"), only("u")), p_z(F.col("z")))).drop("n1", "n2", "ties")


def recommend(k: Column, normal: Column, equal_variance: Column, welch_for_many: bool = True) -> Column:
    """The recommended test. Two policies differ for three groups and more with unequal variances: Welch's analysis or ranks."""
    many = F.lit("welch_anova" if welch_for_many else "kruskal_wallis")
    return F.when(~normal, F.when(k == 2, "mann_whitney").otherwise("kruskal_wallis")).when(equal_variance, F.when(k == 2, "student_t").otherwise("anova")).otherwise(F.when(k == 2, F.lit("welch_t")).otherwise(many))


def label_d(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def label_eta(e: Column) -> Column:
    return F.when(e < 0.01, "negligible").when(e < 0.06, "small").when(e < 0.14, "medium").otherwise("large")


def pairwise_differences(moments: DataFrame) -> DataFrame:
    """category, number, a, b, difference and the studentised range q of every pair of groups (moments of the whole design)."""
    own = Window.partitionBy("category", "number")
    m = moments.withColumns({"mse": F.sum((F.col("n") - 1) * F.col("sd") ** 2).over(own) / (F.sum("n").over(own) - F.count("*").over(own)), "df": F.sum("n").over(own) - F.count("*").over(own)})
    a, b = m.alias("a"), m.alias("b")
    j = a.join(b, (F.col("a.category") == F.col("b.category")) & (F.col("a.number") == F.col("b.number")) & (F.col("a.grp") < F.col("b.grp")))
    q = F.try_divide(F.abs(F.col("a.mean") - F.col("b.mean")), F.sqrt(F.col("a.mse") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n"))))
    return j.select(F.col("a.category").alias("category"), F.col("a.number").alias("number"), F.col("a.grp").alias("a"), F.col("b.grp").alias("b"), (F.col("a.mean") - F.col("b.mean")).alias("difference"), q.alias("q"), F.col("a.df").alias("df"))


def tukey(moments: DataFrame) -> DataFrame:
    """Pairwise differences of group means with Tukey's p."""
    k = moments.groupBy("category", "number").agg(F.count("*").alias("k"))
    return pairwise_differences(moments).join(F.broadcast(k), ["category", "number"]).withColumn("p", p_tukey(F.col("q"), F.col("k"), F.col("df")))


def battery(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """A row for every pair of columns: category, number, n, k, dropped (small groups, in order), reason (why no test is made), normal,
    levene_p, recommended. Groups under three rows are dropped; under two groups there is no test."""
    from .normality import normality_of

    long = pairs_long(df, categories, numbers)
    spark = df.sparkSession
    every = spark.createDataFrame([(c, x) for c in categories for x in numbers], "category string, number string")
    keys = ["category", "number"]
    sized = long.groupBy(*keys, "grp").agg(F.count("*").alias("m"), F.stddev_samp("value").alias("sd"))
    kept = F.col("m") >= LEAST_GROUP
    pairs = sized.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(kept, F.col("m"))), F.lit(0)).alias("n"), F.count_if(kept).alias("k"),
        F.array_join(F.array_sort(F.collect_list(F.when(~kept, F.col("grp")))), ", ").alias("dropped"), F.max(F.when(kept, F.col("sd"))).alias("spread"),
    )
    normal = normality_of(long, [*keys, "grp"]).groupBy(*keys).agg(F.every(F.coalesce(F.col("p") >= 0.05, F.lit(False))).alias("normal"))
    equal = levene(long).select(*keys, p_f(F.col("levene"), F.col("df1"), F.col("df2")).alias("levene_p"))
    found = every.join(pairs, keys, "left").join(normal, keys, "left").join(equal, keys, "left").fillna(0, ["n", "k"])
    reason = F.when(F.col("k") < 2, "fewer than two groups of three rows").when(F.coalesce(F.col("spread"), F.lit(0.0)) == 0, "nothing varies")
    test = recommend(F.col("k"), F.col("normal"), F.col("levene_p") >= 0.05)
    return found.select(*keys, "n", "k", "dropped", reason.alias("reason"), "normal", "levene_p", F.when(reason.isNull(), test).alias("recommended"))
