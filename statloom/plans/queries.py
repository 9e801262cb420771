"""Registered queries of the statistical operators over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjust, cleaning, contingency, correlate, curves, describe, discovery, groups, kinds, neighbours, normality, paired, planning, predict, records, regress, report, scale
from ..sources import bibliography

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEMS = [f"item_{i}" for i in range(1, 9)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    return df.select([F.round(c, own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


_LONG = "(" + _union([f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in LINE]) + ")"

_SKEW = "CASE WHEN count(*) > 2 THEN skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) END"


@query(f"""SELECT variable, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd, round(stddev_samp(v) / sqrt(count(*)), 6) AS se, round(quantile_cont(v, 0.5), 6) AS median,
round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, min(v) AS min, max(v) AS max, round(max(v) - min(v), 6) AS range,
round({_SKEW}, 6) AS skewness, round(kurtosis_pop(v), 6) AS kurtosis, round(100 * stddev_samp(v) / abs(avg(v)), 6) AS cv_percent FROM {_LONG} GROUP BY variable""")
def describe_numeric(spark, sf_dir):
    return rounded(describe.describe_numeric(table(spark, sf_dir, "lineitem"), LINE), mean=5, sd=5)


@query(f"""WITH s AS (SELECT variable, count(*) AS n, {_SKEW} AS g1, kurtosis_pop(v) AS g2 FROM {_LONG} GROUP BY variable)
SELECT variable, n, round(n / 6.0 * (g1 * g1 + g2 * g2 / 4), 3) AS jarque_bera FROM s""")
def jarque_bera(spark, sf_dir):
    return rounded(describe.moment_tests(table(spark, sf_dir, "lineitem"), LINE).select("variable", "n", "jarque_bera"), 3)


@query()
def normality_p(spark, sf_dir):
    from ..functions.special import p_chi2

    t = describe.moment_tests(table(spark, sf_dir, "orders"), ["o_totalprice"])
    return t.withColumns({"jb_p": p_chi2(F.col("jarque_bera"), F.lit(2.0)), "k2_p": p_chi2(F.col("k2"), F.lit(2.0))})


@query()
def mean_intervals(spark, sf_dir):
    return describe.with_interval(describe.describe_numeric(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))


_PART_STATS = _union([f"SELECT '{c}' AS variable, {n} AS is_number, count({c}) AS n, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique FROM {t}" for t, c, n in (
    ("orders", "o_orderstatus", 0), ("orders", "o_orderpriority", 0), ("orders", "o_totalprice", 1), ("orders", "o_custkey", 1))])


@query(f"""SELECT variable, CASE WHEN is_number = 1 AND n_unique >= 7 THEN 'numeric' WHEN is_number = 0 AND n_unique > 25 THEN 'skipped' ELSE 'categorical' END AS kind,
CASE WHEN is_number = 0 AND n_unique > 25 THEN 'free text or id' END AS reason, n, n_missing, n_unique FROM ({_PART_STATS})""")
def detect_variables(spark, sf_dir):
    return describe.detect_variables(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"])


_FREQ = _union([f"SELECT '{c}' AS variable, {c} AS level, count(*) AS n FROM {t} GROUP BY {c}" for t, c in (("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"))])


@query(f"SELECT variable, level, n, round(100.0 * n / sum(n) OVER (PARTITION BY variable), 4) AS percent, count(*) OVER (PARTITION BY variable) AS n_levels FROM ({_FREQ})")
def frequencies(spark, sf_dir):
    return rounded(describe.frequencies(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]), 4)


@query(f"""WITH f AS (SELECT variable, n, sum(n) OVER (PARTITION BY variable) * 1.0 / count(*) OVER (PARTITION BY variable) AS e FROM ({_FREQ}))
SELECT variable, round(sum((n - e) * (n - e) / e), 4) AS statistic, count(*) - 1 AS df FROM f GROUP BY variable""")
def equal_shares(spark, sf_dir):
    return rounded(describe.equal_shares(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]), 4)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM orders")
def drop_repeats(spark, sf_dir):
    return cleaning.drop_repeats(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))


_SPARSE = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END AS l_quantity, CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS l_discount, CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax FROM lineitem"


def _sparse(spark, sf_dir):
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(key % 17 != 0, F.col("l_quantity")).alias("l_quantity"), F.when(key % 5 != 0, F.col("l_discount")).alias("l_discount"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"))


@query(f"SELECT l_linenumber, count(*) AS n FROM ({_SPARSE}) WHERE (l_quantity IS NULL)::INT + (l_discount IS NULL)::INT + (l_tax IS NULL)::INT <= 1.5 GROUP BY l_linenumber")
def drop_sparse(spark, sf_dir):
    return cleaning.drop_sparse(_sparse(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"]).groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT * FROM (" + _union([f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, count(*) AS n_rows FROM ({_SPARSE})" for c in ("l_quantity", "l_discount", "l_tax")]) + ")")
def missing_counts(spark, sf_dir):
    return cleaning.missing_counts(_sparse(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"])


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_type, count(*) AS n, count(CASE WHEN value BETWEEN a - 3 * (b - a) AND b + 3 * (b - a) THEN 1 END) AS n_kept
FROM events, q GROUP BY event_type""")
def null_outliers(spark, sf_dir):
    return cleaning.null_outliers(table(spark, sf_dir, "events"), ["value"]).groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_kept"))


@query(_union([f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 8) AS r, round(regr_slope({b}, {a}), 8) AS slope FROM lineitem" for a, b in _pairs(LINE)]))
def pearson_pairs(spark, sf_dir):
    return rounded(correlate.pearson_pairs(table(spark, sf_dir, "lineitem"), LINE).select("a", "b", "n", "r", "slope"), 8)


@query(_union([f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 8) AS r FROM ({_SPARSE}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _pairs(["l_quantity", "l_discount", "l_tax"])]))
def pearson_pairwise_missing(spark, sf_dir):
    return rounded(correlate.pearson_pairs(_sparse(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"]).select("a", "b", "n", "r"), 8)


@query()
def correlations_adjusted(spark, sf_dir):
    return adjust.adjust_p(correlate.with_p(correlate.pearson_pairs(table(spark, sf_dir, "lineitem"), LINE)))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders)
SELECT count(*) AS n, round(corr(a, b), 8) AS rho FROM r""")
def spearman(spark, sf_dir):
    return rounded(correlate.spearman(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey"), 8)


@query("""WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT CAST(sum(a.n * b.n * sign(b.y - a.y)) AS DOUBLE) AS s FROM c a JOIN c b ON a.x < b.x),
tx AS (SELECT sum(m * (m - 1.0) / 2) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY x)), ty AS (SELECT sum(m * (m - 1.0) / 2) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY y)), t AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM c)
SELECT t.n AS n, s.s AS s, round(s.s / sqrt((t.n * (t.n - 1.0) / 2 - tx.t) * (t.n * (t.n - 1.0) / 2 - ty.t)), 8) AS tau_b FROM t, s, tx, ty""")
def kendall(spark, sf_dir):
    return rounded(correlate.kendall(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount"), 8)


@query("""WITH o AS (SELECT CAST(o_totalprice AS DOUBLE) AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders), s AS (SELECT CAST(sum(sign(b.y - a.y)) AS DOUBLE) AS s FROM o a JOIN o b ON a.x < b.x),
tx AS (SELECT sum(m * (m - 1.0) / 2) AS t FROM (SELECT count(*) AS m FROM o GROUP BY x)), ty AS (SELECT sum(m * (m - 1.0) / 2) AS t FROM (SELECT count(*) AS m FROM o GROUP BY y)), t AS (SELECT count(*) AS n FROM o)
SELECT t.n AS n, s.s AS s, round(s.s / sqrt((t.n * (t.n - 1.0) / 2 - tx.t) * (t.n * (t.n - 1.0) / 2 - ty.t)), 8) AS tau_b FROM t, s, tx, ty""")
def kendall_continuous(spark, sf_dir):
    return rounded(correlate.kendall(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey"), 8)


@query("""WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT CAST(sum(a.n * b.n * sign(b.y - a.y)) AS DOUBLE) AS s FROM c a JOIN c b ON a.x < b.x),
mx AS (SELECT CAST(sum(n) AS DOUBLE) AS m FROM c GROUP BY x), my AS (SELECT CAST(sum(n) AS DOUBLE) AS m FROM c GROUP BY y), t AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM c),
tx AS (SELECT sum(m * (m - 1) / 2) AS t, sum(m * (m - 1) * (m - 2)) AS u, sum(m * (m - 1) * (2 * m + 5)) AS v FROM mx), ty AS (SELECT sum(m * (m - 1) / 2) AS t, sum(m * (m - 1) * (m - 2)) AS u, sum(m * (m - 1) * (2 * m + 5)) AS v FROM my)
SELECT CAST(t.n AS BIGINT) AS n, round(s.s / sqrt((t.n * (t.n - 1) * (2 * t.n + 5) - tx.v - ty.v) / 18 + 2 * tx.t * ty.t / (t.n * (t.n - 1)) + tx.u * ty.u / (9 * t.n * (t.n - 1) * (t.n - 2))), 6) AS z FROM t, s, tx, ty""")
def kendall_z(spark, sf_dir):
    return rounded(correlate.kendall_test(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount").select("n", "z"), 6)


@query("SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def simple_regression(spark, sf_dir):
    return rounded(correlate.simple_regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 8, slope=4, intercept=3)


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS d, count(*) AS n FROM lineitem)
SELECT * FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, n, round(c.a, 7) AS r, round((c.a - c.b * c.d) / sqrt((1 - c.b * c.b) * (1 - c.d * c.d)), 7) AS partial FROM c
UNION ALL SELECT 'l_quantity', 'l_discount', n, round(c.b, 7), round((c.b - c.a * c.d) / sqrt((1 - c.a * c.a) * (1 - c.d * c.d)), 7) FROM c
UNION ALL SELECT 'l_extendedprice', 'l_discount', n, round(c.d, 7), round((c.d - c.a * c.b) / sqrt((1 - c.a * c.a) * (1 - c.b * c.b)), 7) FROM c)""")
def partial_correlations(spark, sf_dir):
    return rounded(correlate.partial_correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).drop("flag"), 7)


_GROUPS = "(" + _union([f"SELECT '{c}' AS category, '{x}' AS number, {c} AS grp, CAST({x} AS DOUBLE) AS v FROM lineitem" for c in ("l_returnflag", "l_linestatus") for x in ("l_quantity", "l_discount")]) + ")"
_MOMENTS = f"m AS (SELECT category, number, grp, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM {_GROUPS} GROUP BY ALL)"


def _line_groups(spark, sf_dir):
    return groups.pairs_long(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])


@query(f"SELECT category, number, grp, count(*) AS n, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS sd, round(quantile_cont(v, 0.5), 8) AS median FROM {_GROUPS} GROUP BY ALL")
def group_moments(spark, sf_dir):
    return rounded(groups.group_moments(_line_groups(spark, sf_dir), median=True), 8)


_ANOVA = """t AS (SELECT category, number, count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS g, sum(n / (sd * sd)) AS w, sum(n / (sd * sd) * mean) / sum(n / (sd * sd)) AS wm FROM m GROUP BY ALL),
s AS (SELECT m.category, m.number, k, t.n AS n, sum(m.n * (mean - g) ** 2) AS ssb, sum((m.n - 1) * sd * sd) AS ssw, sum(m.n / (sd * sd) * (mean - wm) ** 2) AS wss, sum((1 - m.n / (sd * sd) / w) ** 2 / (m.n - 1)) AS lam
FROM m JOIN t ON m.category = t.category AND m.number = t.number GROUP BY m.category, m.number, k, t.n)"""


@query(f"""WITH {_MOMENTS}, {_ANOVA} SELECT category, number, k, CAST(n AS BIGINT) AS n, round(ssb / (k - 1) / (ssw / (n - k)), 6) AS f, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2, round(ssb / (ssb + ssw), 8) AS eta2,
round(wss / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1.0) * lam), 6) AS welch_f, round((k * k - 1) / (3 * lam), 3) AS welch_df2 FROM s""")
def anova(spark, sf_dir):
    return rounded(groups.anova(groups.group_moments(_line_groups(spark, sf_dir))), 6, eta2=8, welch_df2=3)


@query(f"""WITH {_MOMENTS}, p AS (SELECT a.category, a.number, a.grp AS group_a, b.grp AS group_b, a.n AS n1, b.n AS n2, a.mean - b.mean AS d, a.sd ** 2 AS v1, b.sd ** 2 AS v2 FROM m a JOIN m b ON a.category = b.category AND a.number = b.number AND a.grp < b.grp WHERE a.category = 'l_linestatus'),
q AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS vp, v1 / n1 + v2 / n2 AS se2 FROM p)
SELECT category, number, group_a, group_b, n1 + n2 AS n, round(d / sqrt(vp * (1.0 / n1 + 1.0 / n2)), 6) AS t, n1 + n2 - 2 AS df, round(d / sqrt(se2), 6) AS welch_t, round(se2 ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 3) AS welch_df,
round(d / sqrt(vp), 8) AS cohen_d, round(d / sqrt(vp) * (1 - 3.0 / (4 * (n1 + n2) - 9)), 8) AS hedges_g FROM q""")
def two_groups(spark, sf_dir):
    return rounded(groups.two_groups(groups.group_moments(_line_groups(spark, sf_dir))), 6, welch_df=3, cohen_d=8, hedges_g=8)


@query()
def two_groups_p(spark, sf_dir):
    return groups.two_groups_p(groups.two_groups(groups.group_moments(_line_groups(spark, sf_dir))))


@query()
def anova_p(spark, sf_dir):
    return groups.anova_p(groups.anova(groups.group_moments(_line_groups(spark, sf_dir))))


@query(f"""WITH md AS (SELECT category, number, grp, quantile_cont(v, 0.5) AS md FROM {_GROUPS} GROUP BY ALL), d AS (SELECT g.category, g.number, g.grp, abs(v - md) AS v FROM {_GROUPS} g JOIN md ON g.category = md.category AND g.number = md.number AND g.grp = md.grp),
m AS (SELECT category, number, grp, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM d GROUP BY ALL), {_ANOVA} SELECT category, number, k, CAST(n AS BIGINT) AS n, round(ssb / (k - 1) / (ssw / (n - k)), 6) AS levene, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM s""")
def levene(spark, sf_dir):
    return rounded(groups.levene(_line_groups(spark, sf_dir)), 6)


_RANKS = f"""r AS (SELECT category, number, grp, v, rank() OVER (PARTITION BY category, number ORDER BY v) + (count(*) OVER (PARTITION BY category, number, v) - 1) / 2.0 AS r FROM {_GROUPS}),
ti AS (SELECT category, number, sum(m * m * m - m) AS ties FROM (SELECT category, number, CAST(count(*) AS DOUBLE) AS m FROM {_GROUPS} GROUP BY category, number, v) GROUP BY ALL),
rs AS (SELECT category, number, grp, count(*) AS n, sum(r) AS rank_sum FROM r GROUP BY ALL)"""


@query(f"""WITH {_RANKS}, t AS (SELECT rs.category, rs.number, ties, count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(rank_sum * rank_sum / n) AS part FROM rs JOIN ti ON rs.category = ti.category AND rs.number = ti.number GROUP BY rs.category, rs.number, ties),
h AS (SELECT category, number, k, n, (12 / (n * (n + 1)) * part - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM t) SELECT category, number, k, CAST(n AS BIGINT) AS n, round(h, 4) AS h, round((h - k + 1) / (n - k), 8) AS epsilon2 FROM h""")
def kruskal(spark, sf_dir):
    return rounded(groups.kruskal(groups.rank_sums(_line_groups(spark, sf_dir))), 4, epsilon2=8)


@query(f"""WITH {_RANKS}, p AS (SELECT a.category, a.number, ties, CAST(a.n AS DOUBLE) AS n1, CAST(b.n AS DOUBLE) AS n2, a.rank_sum - a.n * (a.n + 1) / 2.0 AS u FROM rs a JOIN rs b ON a.category = b.category AND a.number = b.number AND a.grp < b.grp
JOIN ti ON a.category = ti.category AND a.number = ti.number WHERE a.category = 'l_linestatus')
SELECT category, number, CAST(n1 + n2 AS BIGINT) AS n, u, round(sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z, round(1 - 2 * u / (n1 * n2), 8) AS rank_biserial FROM p""")
def mann_whitney(spark, sf_dir):
    return rounded(groups.mann_whitney(groups.rank_sums(_line_groups(spark, sf_dir))), 6, rank_biserial=8)


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT a, b, 0 FROM (SELECT DISTINCT l_returnflag AS a FROM lineitem), (SELECT DISTINCT l_linestatus AS b FROM lineitem) WHERE (a, b) NOT IN (SELECT (l_returnflag, l_linestatus) FROM lineitem)")
def crosstab(spark, sf_dir):
    return contingency.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n, x.r * y.c * 1.0 / t.n AS e FROM (SELECT a, sum(n) AS r FROM c GROUP BY a) x CROSS JOIN (SELECT b, sum(n) AS c FROM c GROUP BY b) y
CROSS JOIN (SELECT sum(n) AS n FROM c) t LEFT JOIN c ON c.a = x.a AND c.b = y.b), s AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(DISTINCT a) AS n_rows, count(DISTINCT b) AS n_columns, sum((n - e) ** 2 / e) AS s, count(CASE WHEN e < 5 THEN 1 END) AS low FROM e)
SELECT n, n_rows, n_columns, round(s, 6) AS statistic, (n_rows - 1) * (n_columns - 1) AS df, round(sqrt(s / (n * (least(n_rows, n_columns) - 1))), 8) AS cramer_v, low AS low_expected FROM s""")
def chi_square(spark, sf_dir):
    return rounded(contingency.chi_square(contingency.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")), 6, cramer_v=8)


_LABELS = "c AS (SELECT count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END) AS a, count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS b, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS c, count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS d FROM labels)"


def _labels(spark, sf_dir):
    return contingency.crosstab(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"""WITH {_LABELS}, l AS (SELECT *, a + b AS r, c + d AS s, a + c AS k FROM c), x AS (SELECT l.*, unnest(range(greatest(0, k - s), least(r, k) + 1)) AS x FROM l),
w AS (SELECT *, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(s + 1) - lgamma(k - x + 1) - lgamma(s - k + x + 1) AS v, lgamma(r + 1) - lgamma(a + 1) - lgamma(r - a + 1) + lgamma(s + 1) - lgamma(k - a + 1) - lgamma(s - k + a + 1) AS own, lgamma(r + s + 1) - lgamma(k + 1) - lgamma(r + s - k + 1) AS whole FROM x)
SELECT a AS n11, b AS n12, c AS n21, d AS n22, round(CAST(a * d AS DOUBLE) / (b * c), 8) AS odds_ratio, round(least(1.0, sum(CASE WHEN v <= own + 1e-7 THEN exp(v - whole) ELSE 0 END)), 7) AS p FROM w GROUP BY ALL""")
def fisher_exact(spark, sf_dir):
    return rounded(contingency.fisher_exact(_labels(spark, sf_dir)), 8, p=7)


@query(f"""WITH {_LABELS} SELECT a + b + c + d AS n, round((a + d) / (a + b + c + d + 0.0), 8) AS observed, round(((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d) + 0.0), 8) AS expected,
round(((a + d) / (a + b + c + d + 0.0) - ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d) + 0.0)) / (1 - ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d) + 0.0)), 8) AS kappa FROM c""")
def agreement(spark, sf_dir):
    return rounded(contingency.agreement(table(spark, sf_dir, "labels"), "quality", "toxic").drop("weighted_kappa"), 8)


@query(f"WITH {_LABELS} SELECT b AS discordant_a, c AS discordant_b, round((greatest(abs(b - c) - 1, 0)) ** 2 / (b + c), 8) AS statistic FROM c")
def mcnemar(spark, sf_dir):
    return rounded(contingency.mcnemar(_labels(spark, sf_dir)).drop("exact_p"), 8)


@query("""WITH d AS (SELECT count(*) AS n, avg(l_discount - l_tax) AS d, stddev_samp(l_discount - l_tax) AS s FROM lineitem)
SELECT 'l_discount' AS a, 'l_tax' AS b, n, round(d, 8) AS difference, round(s, 8) AS sd, round(d / (s / sqrt(n)), 4) AS t, n - 1 AS df, round(d / s, 7) AS d_z FROM d""")
def paired_t(spark, sf_dir):
    return rounded(paired.paired_t(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"]), 8, t=4, d_z=7)


@query("""WITH d AS (SELECT CAST(l_quantity - l_linenumber AS DOUBLE) AS d FROM lineitem WHERE l_quantity <> l_linenumber), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d),
t AS (SELECT sum(m * m * m - m) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS m FROM d GROUP BY abs(d))), s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm FROM r)
SELECT n, CAST(wp AS DOUBLE) AS w_plus, CAST(wm AS DOUBLE) AS w_minus, CAST(least(wp, wm) AS DOUBLE) AS w, round((least(wp, wm) - n * (n + 1.0) / 4) / sqrt(n * (n + 1.0) * (2.0 * n + 1) / 24 - ties / 48), 6) AS z FROM s, t""")
def wilcoxon(spark, sf_dir):
    return rounded(paired.wilcoxon(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber").drop("ties"), 6)


def _items(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(ITEMS)])


_ITEM_ROWS = "SELECT " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(ITEMS)) + " FROM embeddings"
_TOTAL = " + ".join(ITEMS)


@query(f"""WITH x AS ({_ITEM_ROWS}) SELECT 'item' AS name, 8::BIGINT AS k, count(*) AS n, round(8.0 / 7 * (1 - ({" + ".join(f"var_samp({c})" for c in ITEMS)}) / var_samp({_TOTAL})), 7) AS alpha FROM x""")
def cronbach_alpha(spark, sf_dir):
    return rounded(scale.reliability(_items(spark, sf_dir), {"item": ITEMS}).select("name", "k", "n", "alpha"), 7)


@query(f"WITH x AS ({_ITEM_ROWS}) " + _union([f"SELECT 'item' AS name, '{c}' AS item, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS sd, round(corr({c}, {_TOTAL} - {c}), 7) AS item_total_r FROM x" for c in ITEMS]))
def item_analysis(spark, sf_dir):
    return rounded(scale.item_analysis(_items(spark, sf_dir), {"item": ITEMS}).select("name", "item", "mean", "sd", "item_total_r"), 7)


@query()
def factors(spark, sf_dir):
    return scale.factors(_items(spark, sf_dir), "item", ITEMS)


@query(f"""WITH x AS ({_ITEM_ROWS}), r AS (SELECT """ + ", ".join("1 + " + " + ".join(f"(CASE WHEN {d} < {c} THEN 1 ELSE 0 END)" for d in ITEMS[:4]) + f" + (" + " + ".join(f"(CASE WHEN {d} = {c} THEN 1 ELSE 0 END)" for d in ITEMS[:4]) + f" - 1) / 2.0 AS r{i}" for i, c in enumerate(ITEMS[:4])) + """ FROM x)
SELECT count(*) AS n, 4::BIGINT AS k, round(12.0 / (count(*) * 4 * 5) * (sum(r0) ** 2 + sum(r1) ** 2 + sum(r2) ** 2 + sum(r3) ** 2) - 3.0 * count(*) * 5, 5) AS chi2 FROM r""")
def friedman(spark, sf_dir):
    return rounded(paired.friedman(_items(spark, sf_dir), ITEMS[:4]).drop("kendall_w"), 5)


@query("""WITH m AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, covar_samp(l_extendedprice, l_quantity) AS y1, covar_samp(l_extendedprice, l_discount) AS y2, covar_samp(l_quantity, l_discount) AS c12, var_samp(l_quantity) AS v1, var_samp(l_discount) AS v2, var_samp(l_extendedprice) AS vy FROM lineitem),
b AS (SELECT *, (y1 * v2 - y2 * c12) / (v1 * v2 - c12 * c12) AS b1, (y2 * v1 - y1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m)
SELECT 'l_quantity' AS predictor, n, round(b1, 3) AS b, round(1 / (1 - c12 * c12 / (v1 * v2)), 7) AS vif, round((b1 * y1 + b2 * y2) / vy, 7) AS r2 FROM b UNION ALL SELECT 'l_discount', n, round(b2, 3), round(1 / (1 - c12 * c12 / (v1 * v2)), 7), round((b1 * y1 + b2 * y2) / vy, 7) FROM b""")
def multiple_regression(spark, sf_dir):
    m = regress.ols_all(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"], ["l_extendedprice"])
    return rounded(m.select("predictor", "n", "b", "vif", "r2"), 7, b=3)


@query()
def regression_models(spark, sf_dir):
    return regress.ols_all(table(spark, sf_dir, "lineitem"), LINE)


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("doc_id").cast("double").alias("serial")).join(table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH s AS (SELECT quality AS y, n_chars AS v FROM documents JOIN labels ON documents.doc_id = labels.doc_id), r AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM s),
a AS (SELECT CAST(sum(y) AS BIGINT) AS n1, CAST(sum(1 - y) AS BIGINT) AS n0, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS r1 FROM r), b AS (SELECT *, (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS raw FROM a)
SELECT 'n_chars' AS score, n1, n0, round(greatest(raw, 1 - raw), 8) AS auc, CASE WHEN raw >= 0.5 THEN 'higher' ELSE 'lower' END AS direction FROM b""")
def roc_auc(spark, sf_dir):
    return rounded(regress.roc_auc(_scored(spark, sf_dir), "quality", ["n_chars"]).select("score", "n1", "n0", "auc", "direction"), 8)


@query("""WITH s AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS v FROM documents JOIN labels ON documents.doc_id = labels.doc_id), c AS (SELECT v, sum(y) AS o, sum(1 - y) AS z FROM s GROUP BY v),
r AS (SELECT v, sum(o) OVER (ORDER BY v DESC) / sum(o) OVER () AS tpr, sum(z) OVER (ORDER BY v DESC) / sum(z) OVER () AS fpr FROM c)
SELECT v AS cutoff, round(tpr, 8) AS sensitivity, round(1 - fpr, 8) AS specificity, round(tpr - fpr, 8) AS j FROM r ORDER BY round(tpr - fpr, 12) DESC, v DESC LIMIT 1""")
def youden(spark, sf_dir):
    return rounded(regress.youden(_scored(spark, sf_dir), "quality", "n_chars"), 8)


@query()
def logistic(spark, sf_dir):
    scored = _scored(spark, sf_dir).select("quality", (F.col("n_chars") / 1000).alias("kilo_chars"), (F.col("serial") % 97).alias("noise"))
    return regress.logistic(scored, "quality", ["kilo_chars", "noise"])


@query()
def interactions(spark, sf_dir):
    return regress.interactions(table(spark, sf_dir, "lineitem"), "l_extendedprice", LINE)


@query("""WITH p AS (SELECT count(*) AS n, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, regr_slope(p_retailprice, ln(p_size)) AS lb, regr_intercept(p_retailprice, ln(p_size)) AS la, regr_slope(p_retailprice, 1.0 / p_size) AS ib, regr_intercept(p_retailprice, 1.0 / p_size) AS ia,
regr_slope(ln(p_retailprice), p_size) AS eb, regr_intercept(ln(p_retailprice), p_size) AS ea, regr_slope(ln(p_retailprice), ln(p_size)) AS pb, regr_intercept(ln(p_retailprice), ln(p_size)) AS pa FROM part),
e AS (SELECT unnest([{'m': 'linear', 'e': p_retailprice - a - b * p_size}, {'m': 'logarithmic', 'e': p_retailprice - la - lb * ln(p_size)}, {'m': 'inverse', 'e': p_retailprice - ia - ib / p_size}, {'m': 'exponential', 'e': p_retailprice - exp(ea + eb * p_size)}, {'m': 'power', 'e': p_retailprice - exp(pa + pb * ln(p_size))}]) AS x, n FROM part, p)
SELECT x.m AS model, n, round(sum(x.e * x.e), 1) AS sse FROM e GROUP BY ALL""")
def curve_fits(spark, sf_dir):
    fits = curves.fit_curves(table(spark, sf_dir, "part"), "p_size", "p_retailprice").where(~F.col("model").isin("quadratic", "cubic"))
    return rounded(fits.select("model", "n", "sse"), 1)


@query()
def hidden_formulas(spark, sf_dir):
    return curves.hidden_formulas(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


@query(f"""WITH t AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS i FROM (SELECT l_linestatus || l_returnflag AS family, CAST(l_linenumber AS VARCHAR) || ':' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS id, (sum(l_orderkey) * 7919 % 100003) / 100003.0 AS p FROM lineitem GROUP BY ALL))
SELECT family, id, round(p, 9) AS p, round(least(1, p * m), 9) AS p_bonferroni, round(max(least(1, p * (m - i + 1))) OVER (PARTITION BY family ORDER BY i), 9) AS p_holm, round(min(least(1, p * m / i)) OVER (PARTITION BY family ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS p_bh FROM t""")
def adjusted_p(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    tests = line.groupBy(F.concat("l_linestatus", "l_returnflag").alias("family"), F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_quantity").cast("long").cast("string")).alias("id")).agg(((F.sum("l_orderkey") * 7919 % 100003) / 100003).alias("p"))
    return rounded(adjust.adjust_p(tests, family=["family"]).drop("significant_bh"), 9)


_REFS = """r AS (SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || source || lang END AS doi, text AS title, CASE WHEN doc_id % 2 = 0 THEN lang END AS abstract, n_chars AS cited_by, source AS finding FROM documents),
k AS (SELECT *, coalesce(lower(doi), 't:' || substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 80)) AS key FROM r)"""


@query(f"WITH {_REFS} SELECT key, min(seq) AS seq, arg_min(abstract, seq) FILTER (WHERE abstract IS NOT NULL) AS abstract, max(cited_by) AS cited_by, count(DISTINCT finding) AS n_findings, count(*) AS merged FROM k GROUP BY key")
def dedup_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    refs = d.select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/"), "source", "lang")).alias("doi"), F.col("text").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("abstract"), F.col("n_chars").alias("cited_by"), F.array("source").alias("findings"), F.lit(0.0).alias("score"))
    return records.dedup_records(refs).select("key", "seq", "abstract", "cited_by", F.size("findings").cast("long").alias("n_findings"), "merged")


_MARKED = "SELECT doc_id, text || ' [' || CAST(doc_id % 50 AS VARCHAR) || ', ' || CAST(doc_id % 7 AS VARCHAR) || ']' AS text FROM documents"


def _marked(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" ["), (F.col("doc_id") % 50).cast("string"), F.lit(", "), (F.col("doc_id") % 7).cast("string"), F.lit("]")).alias("text"))


@query(f"""WITH t AS ({_MARKED}), m AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda x: regexp_split_to_array(x, '\\s*,\\s*'))) AS ids FROM t)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, CAST(ids[i] AS BIGINT) AS id FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM m)""")
def citation_markers(spark, sf_dir):
    return records.markers(_marked(spark, sf_dir), "doc_id", "text")


@query(f"""WITH t AS ({_MARKED}), m AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda x: regexp_split_to_array(x, '\\s*,\\s*'))) AS ids FROM t),
e AS (SELECT doc_id, i, CAST(ids[i] AS BIGINT) AS id FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM m)), f AS (SELECT id, min(doc_id * 100000 + i) AS place FROM e GROUP BY id) SELECT id AS old, row_number() OVER (ORDER BY place) AS new FROM f""")
def renumbering(spark, sf_dir):
    return records.first_appearance(records.markers(_marked(spark, sf_dir), "doc_id", "text"), ["doc_id", "pos"])


@query("SELECT doc_id, n_words FROM (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents) WHERE n_words < 60")
def short_sections(spark, sf_dir):
    return records.short_sections(table(spark, sf_dir, "documents"), "doc_id", "text", 60)


PARTS = ["p_size", "p_retailprice"]


@query()
def normality_tests(spark, sf_dir):
    return rounded(normality.normality(table(spark, sf_dir, "part"), PARTS), 8)


@query()
def distribution_tests(spark, sf_dir):
    long = describe.long_form(table(spark, sf_dir, "lineitem"), LINE)
    return rounded(normality.distribution_tests(long, ["variable"]), 8)


@query()
def shapiro_wilk_groups(spark, sf_dir):
    long = groups.pairs_long(table(spark, sf_dir, "part"), ["p_type"], PARTS)
    return rounded(normality.shapiro_wilk(long, ["category", "number", "grp"]), 8)


@query()
def tukey(spark, sf_dir):
    return rounded(groups.tukey(groups.group_moments(_line_groups(spark, sf_dir))), 8)


@query(f"""WITH p AS (SELECT a.category, a.number, a.grp AS a, b.grp AS b FROM (SELECT DISTINCT category, number, grp FROM {_GROUPS}) a JOIN (SELECT DISTINCT category, number, grp FROM {_GROUPS}) b ON a.category = b.category AND a.number = b.number AND a.grp < b.grp),
x AS (SELECT p.*, g.grp, g.v FROM p JOIN {_GROUPS} g ON p.category = g.category AND p.number = g.number AND g.grp IN (p.a, p.b)), r AS (SELECT *, rank() OVER (PARTITION BY category, number, a, b ORDER BY v) + (count(*) OVER (PARTITION BY category, number, a, b, v) - 1) / 2.0 AS r FROM x)
SELECT category, number, a, b, count(*) AS n, sum(CASE WHEN grp = a THEN r ELSE 0 END) - count(CASE WHEN grp = a THEN 1 END) * (count(CASE WHEN grp = a THEN 1 END) + 1) / 2.0 AS u, round(quantile_cont(CASE WHEN grp = a THEN v END, 0.5) - quantile_cont(CASE WHEN grp = b THEN v END, 0.5), 8) AS median_difference FROM r GROUP BY ALL""")
def pairwise_mann_whitney(spark, sf_dir):
    return rounded(groups.pairwise_mann_whitney(_line_groups(spark, sf_dir)).drop("z", "p"), 8)


@query("""WITH t AS (SELECT 'l_linestatus' AS variable, l_linestatus AS level, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT variable, arg_min(level, (n, -ascii(level))) AS event, min(n) AS n_event, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY variable""")
def binary_outcomes(spark, sf_dir):
    return kinds.binary_outcomes(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_returnflag"])


@query()
def infer_kinds(spark, sf_dir):
    return kinds.infer_kinds(table(spark, sf_dir, "orders"))


@query("""WITH x AS (SELECT l_quantity AS x, CAST(l_discount AS DOUBLE) AS y FROM lineitem), c AS (SELECT x, y, count(*) AS m FROM x GROUP BY ALL),
j AS (SELECT m, sum(m) OVER () AS n, sum(m) OVER (PARTITION BY x) AS mx, sum(m) OVER (PARTITION BY y) AS my, x, y FROM c)
SELECT 'l_quantity' AS a, 'l_discount' AS b, CAST(max(n) AS BIGINT) AS n, round(greatest(0, sum(m / n * ln(m * n / (mx * my))) - (count(*) - count(DISTINCT x) - count(DISTINCT y) + 1) / (2 * max(n))), 8) AS mi FROM j""")
def mutual_information(spark, sf_dir):
    # finer bins than either column has values: each value is its own bin
    return rounded(discovery.binned_information(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], bins=2000).select("a", "b", "n", "mi"), 8)


@query()
def nonlinear_finds(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_size", (F.col("p_size") ** 2 - 51 * F.col("p_size")).alias("bent"), "p_retailprice")
    return rounded(discovery.nonlinear_finds(neighbours.mutual_information(part, ["p_size", "bent", "p_retailprice"])), 6)


@query()
def hidden_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(ITEMS)])
    assigned, _ = discovery.clusters(rows, "key", ITEMS)
    return rounded(discovery.cluster_profile(rows, "key", ITEMS, assigned).select("cluster", "n", "share", F.transform("traits", lambda t: t["variable"]).alias("traits")))


@query()
def anomalies(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), *LINE)
    return rounded(discovery.anomalies(orders, "key", LINE).select("key", "score"))


def _outcomes(spark, sf_dir):
    """Labels as texts, with numbers and categories of their documents."""
    scored = _scored(spark, sf_dir).select("doc_id", "quality", "toxic", "n_chars", (F.col("serial") % 97).alias("noise"))
    return scored.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", "left").withColumns({c: F.when(F.col(c) == 1, "yes").otherwise("no") for c in ("quality", "toxic")})


@query()
def risk_scores(spark, sf_dir):
    scores, _ = predict.risk(_outcomes(spark, sf_dir), "doc_id", ["quality", "toxic"], ["n_chars", "noise"], ["lang", "source"])
    return rounded(scores)


@query()
def risk_models(spark, sf_dir):
    _, models = predict.risk(_outcomes(spark, sf_dir), "doc_id", ["quality", "toxic"], ["n_chars", "noise"], ["lang", "source"])
    return rounded(models.select("outcome", "risky", "n", "n_risky", "auc", "strength", F.transform("top", lambda t: t["variable"]).alias("top"), "by_gain"), 4)


@query()
def predictability(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", *PARTS, "p_brand", "p_type")
    found = predict.predictability(part, "p_partkey", PARTS, ["p_brand", "p_type"])
    return rounded(found.withColumn("top", F.transform("top", lambda t: t["variable"])), 4)


@query("""SELECT doc_id, lang || ' Doe' AS author, '10.1/' || doc_id AS doi, source AS title, CAST(2000 + doc_id % 20 AS INT) AS year, '7-' || (7 + doc_id % 5) AS pages, 'deep ' || source AS abstract FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def flattened_works(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    place = F.struct(F.lit("7").alias("first_page"), (7 + F.col("doc_id") % 5).cast("string").alias("last_page"))
    raw = F.to_json(F.struct(
        F.col("source").alias("display_name"), F.concat(F.lit("https://doi.org/10.1/"), "doc_id").alias("doi"), (2000 + F.col("doc_id") % 20).alias("publication_year"), place.alias("biblio"),
        F.array(F.struct(F.struct(F.concat("lang", F.lit(" Doe")).alias("display_name")).alias("author"))).alias("authorships"), F.create_map("source", F.array(F.lit(1)), F.lit("deep"), F.array(F.lit(0))).alias("abstract_inverted_index"),
    ))
    return bibliography.flatten_works(d.select("doc_id", raw.alias("raw")), "raw").select("doc_id", F.col("authors")[0].alias("author"), "doi", "title", "year", "pages", "abstract")


def _planned(df: DataFrame, target: str) -> DataFrame:
    """The plan of one table, with one variable marked as dependent."""
    return planning.plan_table(df, kinds.infer_kinds(df).withColumn("role", F.when(F.col("variable") == target, "dv").otherwise("auto")))


@query()
def planned_tests(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_size", "p_retailprice", "p_type", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority")  # its levels qualify for an association
    plans = _planned(part, "p_retailprice")
    return plans.unionByName(_planned(orders, "o_totalprice"))


@query()
def significant_findings(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    pairs = correlate.with_p(correlate.pearson_pairs(lines, LINE))
    tests = groups.anova_p(groups.anova(groups.group_moments(_line_groups(spark, sf_dir))))
    changes = paired.paired_t_p(paired.paired_t(lines, LINE))
    found = [report.as_findings(pairs, "correlation", "a", "b", "r"), report.as_findings(tests, "group", "number", "category", "eta2"), report.as_findings(changes, "paired", "a", "b", "d_z")]
    return rounded(report.significant_findings(found), 8)
