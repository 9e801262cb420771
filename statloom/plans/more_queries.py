"""Further registered queries: p values, labels, records, markers and reports over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import p_chi2
from ..operators import adjust, cleaning, contingency, correlate, curves, describe, findings, groups, kinds, normality, records, regress, report, scale
from ..sources import bibliography, tables
from . import queries as base
from .queries import _ANOVA, _FREQ, _GROUPS, _ITEM_ROWS, _LONG, _MARKED, _MOMENTS, _RANKS, _SKEW, _TOTAL, ITEMS, LINE, _items, _line_groups, _marked, _pairs, _scored, _union, query, rounded, table

# Tails of distributions in SQL: Simpson's rule over the density, after a substitution that keeps it smooth.


def _simpson(density: str, upper: str, panels: int = 2000) -> str:
    """The integral of a density in x from 0 to ``upper``."""
    x = f"(i * ({upper}) / {panels}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {panels} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(({upper}) / {3 * panels}.0 * list_sum(list_transform(range(0, {panels + 1}), lambda i: {weight} * {density.replace('{x}', x)})))"


def sql_p_t(t: str, v: str) -> str:
    return f"greatest(0, 1 - 2 * exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * {_simpson(f'pow(1 + {{x}} * {{x}} / {v}, -({v} + 1) / 2.0)', f'least(abs({t}), 40)')})"


def sql_p_chi2(x: str, k: str) -> str:
    return f"greatest(0, 1 - {_simpson(f'2 * pow({{x}}, {k} - 1) * exp(-{{x}} * {{x}} / 2)', f'sqrt(least({x}, {k} + 40 * sqrt(2 * {k}) + 200))')} / pow(2, {k} / 2.0) / exp(lgamma({k} / 2.0)))"


def sql_p_f(f: str, a: str, b: str) -> str:
    upper = f"least(sqrt({a} * {f} / ({a} * {f} + {b})), sqrt(least(1, ({a} + 20 * sqrt(2 * {a}) + 200) / {b})))"
    whole = f"exp(lgamma({a} / 2.0) + lgamma({b} / 2.0) - lgamma(({a} + {b}) / 2.0))"
    return f"greatest(0, 1 - {_simpson(f'2 * pow({{x}}, {a} - 1) * pow(1 - {{x}} * {{x}}, {b} / 2.0 - 1)', upper)} / {whole})"


def sql_strength(r: str) -> str:
    return f"CASE WHEN abs({r}) < 0.1 THEN 'negligible' WHEN abs({r}) < 0.3 THEN 'weak' WHEN abs({r}) < 0.5 THEN 'moderate' WHEN abs({r}) < 0.7 THEN 'strong' ELSE 'very strong' END"


# Descriptives and typing


@query(f"""WITH q AS (SELECT variable, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM {_LONG} GROUP BY variable)
SELECT l.variable, count(CASE WHEN b > a AND (v < a - 1 * (b - a) OR v > b + 1 * (b - a)) THEN 1 END) AS n_outliers FROM {_LONG} l JOIN q ON l.variable = q.variable GROUP BY l.variable""")
def outlier_counts(spark, sf_dir):
    return describe.outlier_counts(table(spark, sf_dir, "lineitem"), LINE, width=1.0)


_T975 = "(z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3))"


@query(f"""WITH s AS (SELECT variable, count(*) AS n, avg(v) AS mean, stddev_samp(v) / sqrt(count(*)) AS se, count(*) - 1.0 AS v, 1.959963984540054 AS z FROM {_LONG} GROUP BY variable)
SELECT variable, n, round(mean, 5) AS mean, round(mean - {_T975} * se, 5) AS ci_low, round(mean + {_T975} * se, 5) AS ci_high FROM s""")
def mean_confidence(spark, sf_dir):
    found = describe.with_interval(describe.describe_numeric(table(spark, sf_dir, "lineitem"), LINE))
    return rounded(found.select("variable", "n", "mean", "ci_low", "ci_high"), 5)


@query()
def full_descriptives(spark, sf_dir):
    return rounded(describe.describe_fully(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]), 6)


_SERIAL = [("customer", "c_custkey"), ("customer", "c_acctbal"), ("customer", "c_nationkey"), ("customer", "c_gap")]
_CUSTOMERS = "(SELECT c_custkey, c_acctbal, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey * 3 + 7000000 END AS c_gap FROM customer)"


@query(_union([f"""SELECT variable, CASE WHEN serial THEN 'skipped' WHEN n_unique >= 7 THEN 'numeric' ELSE 'categorical' END AS kind, CASE WHEN serial THEN 'id' END AS reason, n, n_missing, n_unique FROM (
SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique,
count(DISTINCT {c}) = count({c}) AND bool_and({c} % 1 = 0) AND (SELECT count(*) FROM {_CUSTOMERS} a JOIN {_CUSTOMERS} b ON a.{c} = b.{c} + 1) >= (count({c}) - 1) // 2 + 1 AS serial FROM {_CUSTOMERS})""" for _, c in _SERIAL]))
def serial_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") * 3 + 7000000).alias("c_gap"))
    return describe.detect_variables(c)


@query("SELECT 'price' AS variable, count(p_retailprice) AS n, round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS min, max(p_retailprice) AS max FROM part WHERE p_size <> 7")
def decimal_commas(spark, sf_dir):
    text = F.when(F.col("p_size") == 7, "n/a").otherwise(F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")))
    return rounded(describe.describe_numeric(table(spark, sf_dir, "part").select(text.alias("price")), ["price"]).select("variable", "n", "mean", "min", "max"))


@query("SELECT * FROM (" + _union([f"SELECT '{c}' AS variable FROM (SELECT *, 1 AS one FROM orders) HAVING count(DISTINCT {c}) <= 1" for c in ("one", "o_orderstatus", "o_custkey")]) + ")")
def constant_columns(spark, sf_dir):
    return cleaning.constant_columns(table(spark, sf_dir, "orders").select(F.lit(1).alias("one"), "o_orderstatus", "o_custkey"))


@query("""WITH n AS (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part)
SELECT name, 'block' AS severity, 'fewer than 10 rows' AS message FROM n WHERE n < 10 UNION ALL SELECT name, 'warn', 'fewer than 30 rows' FROM n WHERE n >= 10 AND n < 30""")
def integrity_issues(spark, sf_dir):
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).withColumn("name", F.lit(t)) for t in ("region", "nation", "part")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).select("name", F.inline(kinds.integrity(F.col("n"), F.lit(3))))


@query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1.0 ELSE 0 END)::DOUBLE AS ones, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def coded_predictors(spark, sf_dir):
    coded, names = kinds.code_binary(table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag"), ["l_linestatus", "l_returnflag"])
    return coded.groupBy("l_returnflag").agg(F.sum(names["l_linestatus"]).alias("ones"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT l_linenumber, l_quantity, l_discount, l_tax FROM lineitem_sparse), k AS (SELECT * FROM d WHERE (l_quantity IS NULL)::INT + (l_discount IS NULL)::INT + (l_tax IS NULL)::INT <= 1.5),
c AS (SELECT 0 AS i, count(*) AS n, count(l_quantity) + count(l_discount) + count(l_tax) AS c FROM lineitem_sparse UNION ALL SELECT 1, count(*), count(l_quantity) + count(l_discount) + count(l_tax) FROM d UNION ALL SELECT 2, count(*), count(l_quantity) + count(l_discount) + count(l_tax) FROM k)
SELECT 'drop_repeats' AS step, a.n AS n_before, b.n AS n_after, a.c - b.c AS cells FROM c a, c b WHERE a.i = 0 AND b.i = 1 UNION ALL SELECT 'drop_sparse', a.n, b.n, a.c - b.c FROM c a, c b WHERE a.i = 1 AND b.i = 2
UNION ALL SELECT 'null_outliers', n, n, 0 FROM c WHERE i = 2""".replace("lineitem_sparse", f"(SELECT l_linenumber, l_quantity, l_discount, l_tax FROM ({base._SPARSE}))"))
def cleaning_report(spark, sf_dir):
    sparse = base._sparse(spark, sf_dir).select("l_linenumber", "l_quantity", "l_discount", "l_tax")
    return cleaning.cleaning_report(sparse, ["l_quantity", "l_discount", "l_tax"])


@query("""WITH q AS (SELECT event_type, value, quantile_cont(value, 0.25) OVER () AS a, quantile_cont(value, 0.75) OVER () AS b FROM events)
SELECT 'value' AS variable, count(CASE WHEN value < a - 3 * (b - a) OR value > b + 3 * (b - a) THEN 1 END) AS n_outliers FROM q""")
def outlier_cells(spark, sf_dir):
    return cleaning.outlier_cells(table(spark, sf_dir, "events"), ["value"])


@query("SELECT least(500, count(*)) AS n, count(DISTINCT p_partkey) >= 500 AS whole FROM part")
def down_sampled(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sample = cleaning.down_sampled(part, "p_partkey", 500)
    again = cleaning.down_sampled(part.repartition(7), "p_partkey", 500)
    return sample.join(again.select("p_partkey"), "p_partkey").agg(F.count("*").alias("n")).crossJoin(part.agg((F.count_distinct("p_partkey") >= 500).alias("whole")))


# Normality from moments

_G = f"SELECT variable, count(*)::DOUBLE AS n, {_SKEW} AS g1, kurtosis_pop(v) AS g2 FROM {_LONG} GROUP BY variable"
_K2 = f"""g AS ({_G}), k1 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
(g2 - (3 * (n - 1) / (n + 1) - 3)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM g),
k2 AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a FROM k1),
k3 AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS s, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS i FROM k2),
k4 AS (SELECT variable, n::BIGINT AS n, n / 6 * (g1 * g1 + g2 * g2 / 4) AS jb, ln(s + sqrt(s * s + 1)) / sqrt(ln(sqrt(w2))) AS z1, (1 - 2 / (9 * a) - sign(i) * pow(abs(i), 1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM k3)"""


@query(f"WITH {_K2} SELECT variable, n, round(jb, 3) AS jarque_bera, round(z1, 4) AS z_skew, round(z2, 4) AS z_kurt, round(z1 * z1 + z2 * z2, 3) AS k2, round(exp(-jb / 2), 6) AS jarque_bera_p, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS k2_p FROM k4")
def moment_normality(spark, sf_dir):
    t = describe.moment_tests(table(spark, sf_dir, "lineitem"), LINE)
    p = lambda c: p_chi2(F.col(c), F.lit(2.0))
    return rounded(t.withColumns({"jarque_bera_p": p("jarque_bera"), "k2_p": p("k2")}), 6, jarque_bera=3, k2=3, z_skew=4, z_kurt=4)


@query(f"WITH {_K2} SELECT variable, 'dagostino_k2' AS test, n, round(z1 * z1 + z2 * z2, 3) AS statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p, CASE WHEN exp(-(z1 * z1 + z2 * z2) / 2) >= 0.05 THEN 'yes' ELSE 'no' END AS normal FROM k4")
def large_sample_normality(spark, sf_dir):
    return rounded(normality.normality(table(spark, sf_dir, "lineitem"), LINE).withColumn("normal", normality.verdict(F.col("p"))), 6, statistic=3)


@query(f"SELECT variable, n::BIGINT AS n, abs(g1) < 1 AND abs(g2) < 3 AS normal FROM ({_G})")
def balanced_normality(spark, sf_dir):
    return normality.balanced_normality(describe.long_form(table(spark, sf_dir, "lineitem"), LINE), ["variable"])


# Correlations


def _pearson_sql(source: str, pairs: list[tuple[str, str]]) -> str:
    return _union([f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r FROM {source}" for a, b in pairs])


@query(f"""WITH c AS ({_pearson_sql('lineitem', _pairs(LINE))}), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df, 0.5 * ln((1 + r) / (1 - r)) AS z, 1.96 / sqrt(n - 3) AS h FROM c)
SELECT a, b, n, round(r, 8) AS r, round(tanh(z - h), 7) AS ci_low, round(tanh(z + h), 7) AS ci_high, {sql_strength('r')} AS strength, round({sql_p_t('t', 'df')}, 6) AS p FROM t""")
def pearson_tests(spark, sf_dir):
    found = correlate.with_p(correlate.pearson_pairs(table(spark, sf_dir, "lineitem"), LINE))
    return rounded(found.select("a", "b", "n", "r", "ci_low", "ci_high", "strength", "p"), 6, r=8, ci_low=7, ci_high=7)


@query("SELECT 'l_extendedprice' AS a, 'paid' AS b, round(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 8) AS r FROM lineitem HAVING abs(corr(l_extendedprice, l_extendedprice * (1 - l_discount))) >= 0.95")
def redundant_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    return rounded(correlate.redundant_pairs(correlate.pearson_pairs(lines, lines.columns)).select("a", "b", "r"), 8)


_ORDER_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))


@query(f"""WITH k AS (SELECT {_ORDER_RANKS} FROM lineitem), c AS ({_pearson_sql('k', _pairs(['l_quantity', 'l_extendedprice', 'l_discount']))}), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM c)
SELECT a, b, n, round(r, 8) AS rho, round({sql_p_t('t', 'df')}, 6) AS p FROM t""")
def spearman_tests(spark, sf_dir):
    return rounded(correlate.with_p(correlate.spearman_pairs(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "rho"), 6, rho=8)


# Groups

_TWO = f"""{_MOMENTS}, p AS (SELECT a.category, a.number, a.grp AS group_a, b.grp AS group_b, a.n AS n1, b.n AS n2, a.mean - b.mean AS d, a.sd ** 2 AS v1, b.sd ** 2 AS v2 FROM m a JOIN m b ON a.category = b.category AND a.number = b.number AND a.grp < b.grp
WHERE a.category IN (SELECT category FROM m GROUP BY category, number HAVING count(*) = 2)),
q AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS vp, v1 / n1 + v2 / n2 AS se2 FROM p),
t AS (SELECT *, d / sqrt(vp * (1.0 / n1 + 1.0 / n2)) AS t, (n1 + n2 - 2)::DOUBLE AS df, d / sqrt(se2) AS wt, se2 ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS wdf, d / sqrt(vp) AS cd FROM q)"""
_LABEL_D = "CASE WHEN abs(cd) < 0.2 THEN 'negligible' WHEN abs(cd) < 0.5 THEN 'small' WHEN abs(cd) < 0.8 THEN 'medium' ELSE 'large' END"
_LABEL_ETA = "CASE WHEN e < 0.01 THEN 'negligible' WHEN e < 0.06 THEN 'small' WHEN e < 0.14 THEN 'medium' ELSE 'large' END"


@query(f"WITH {_TWO} SELECT category, number, round({sql_p_t('t', 'df')}, 6) AS p, round({sql_p_t('wt', 'wdf')}, 6) AS welch_p, {_LABEL_D} AS effect FROM t")
def t_test_p(spark, sf_dir):
    found = groups.two_groups_p(groups.two_groups(groups.group_moments(_line_groups(spark, sf_dir))))
    return rounded(found.select("category", "number", "p", "welch_p", groups.label_d(F.col("cohen_d")).alias("effect")))


_F = f"""{_MOMENTS}, {_ANOVA}, f AS (SELECT category, number, k, n, ssb / (k - 1) / (ssw / (n - k)) AS f, (k - 1)::DOUBLE AS d1, (n - k)::DOUBLE AS d2, ssb / (ssb + ssw) AS e, wss / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1.0) * lam) AS wf, (k * k - 1) / (3 * lam) AS wd FROM s)"""


@query(f"WITH {_F} SELECT category, number, round({sql_p_f('f', 'd1', 'd2')}, 6) AS p, round({sql_p_f('wf', 'd1', 'wd')}, 6) AS welch_p, {_LABEL_ETA} AS effect FROM f")
def anova_tests(spark, sf_dir):
    found = groups.anova_p(groups.anova(groups.group_moments(_line_groups(spark, sf_dir))))
    return rounded(found.select("category", "number", "p", "welch_p", groups.label_eta(F.col("eta2")).alias("effect")))


_LEVENE = f"""md AS (SELECT category, number, grp, quantile_cont(v, 0.5) AS md FROM {_GROUPS} GROUP BY ALL), ds AS (SELECT g.category, g.number, g.grp, abs(v - md) AS v FROM {_GROUPS} g JOIN md ON g.category = md.category AND g.number = md.number AND g.grp = md.grp),
m AS (SELECT category, number, grp, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM ds GROUP BY ALL), {_ANOVA}, lv AS (SELECT category, number, k, n, ssb / (k - 1) / (ssw / (n - k)) AS f, (k - 1)::DOUBLE AS d1, (n - k)::DOUBLE AS d2 FROM s)"""


@query(f"WITH {_LEVENE} SELECT category, number, n::BIGINT AS n, k, '' AS dropped, NULL::VARCHAR AS reason, round({sql_p_f('f', 'd1', 'd2')}, 6) AS levene_p FROM lv UNION ALL SELECT 'one', 'l_quantity', count(*), 1, '', 'fewer than two groups of three rows', NULL FROM lineitem UNION ALL SELECT 'one', 'l_discount', count(*), 1, '', 'fewer than two groups of three rows', NULL FROM lineitem")
def group_battery(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("one", F.lit("x"))
    return rounded(groups.battery(lines, ["l_returnflag", "l_linestatus", "one"], ["l_quantity", "l_discount"]).drop("normal", "recommended"))


@query(f"""WITH {_LEVENE}, l AS (SELECT category, number, k, {sql_p_f('f', 'd1', 'd2')} AS p FROM lv), j AS (SELECT category, number, grp, count(*) / 6.0 * ({_SKEW.replace('v)', 'v)')} ** 2 + kurtosis_pop(v) ** 2 / 4) AS jb FROM {_GROUPS} GROUP BY ALL),
n AS (SELECT category, number, bool_and(exp(-jb / 2) >= 0.05) AS normal FROM j GROUP BY ALL), b AS (SELECT l.category, l.number, k, normal, p >= 0.05 AS equal FROM l JOIN n ON l.category = n.category AND l.number = n.number UNION ALL SELECT category || '+', number, k, true, p >= 0.05 FROM l)
SELECT category, number, CASE WHEN NOT normal THEN CASE WHEN k = 2 THEN 'mann_whitney' ELSE 'kruskal_wallis' END WHEN equal THEN CASE WHEN k = 2 THEN 'student_t' ELSE 'anova' END WHEN k = 2 THEN 'welch_t' ELSE 'welch_anova' END AS first,
CASE WHEN NOT normal THEN CASE WHEN k = 2 THEN 'mann_whitney' ELSE 'kruskal_wallis' END WHEN equal THEN CASE WHEN k = 2 THEN 'student_t' ELSE 'anova' END WHEN k = 2 THEN 'welch_t' ELSE 'kruskal_wallis' END AS second FROM b""")
def recommended_tests(spark, sf_dir):
    """Both policies, with normality from moments, and once more as if all groups were normal."""
    long = _line_groups(spark, sf_dir)
    normal = describe.moment_tests_of(long, ["category", "number", "grp"]).groupBy("category", "number").agg(F.every(p_chi2(F.col("jarque_bera"), F.lit(2.0)) >= 0.05).alias("normal"))
    own = groups.levene(long).select("category", "number", "k", (groups.p_f(F.col("levene"), F.col("df1"), F.col("df2")) >= 0.05).alias("equal"))
    both = own.join(normal, ["category", "number"]).unionByName(own.select(F.concat("category", F.lit("+")).alias("category"), "number", "k", "equal", F.lit(True).alias("normal")))
    rule = lambda welch: groups.recommend(F.col("k"), F.col("normal"), F.col("equal"), welch)
    return both.select("category", "number", rule(True).alias("first"), rule(False).alias("second"))


@query(f"""WITH {_RANKS}, t AS (SELECT rs.category, rs.number, ties, count(*)::DOUBLE AS k, CAST(sum(n) AS DOUBLE) AS n, sum(rank_sum * rank_sum / n) AS part FROM rs JOIN ti ON rs.category = ti.category AND rs.number = ti.number GROUP BY rs.category, rs.number, ties),
h AS (SELECT category, number, k - 1 AS df, (12 / (n * (n + 1)) * part - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM t) SELECT category, number, round({sql_p_chi2('h', 'df')}, 6) AS p FROM h""")
def kruskal_p(spark, sf_dir):
    k = groups.kruskal(groups.rank_sums(_line_groups(spark, sf_dir)))
    return rounded(k.select("category", "number", p_chi2(F.col("h"), F.col("k") - 1).alias("p")))


@query(f"WITH {_MOMENTS}, w AS (SELECT *, sum((n - 1) * sd * sd) OVER g / (sum(n) OVER g - count(*) OVER g) AS mse, (sum(n) OVER g - count(*) OVER g)::BIGINT AS df FROM m WINDOW g AS (PARTITION BY category, number)) SELECT a.category, a.number, a.grp AS a, b.grp AS b, round(a.mean - b.mean, 6) AS difference, round(abs(a.mean - b.mean) / sqrt(a.mse / 2 * (1.0 / a.n + 1.0 / b.n)), 5) AS q, a.df AS df FROM w a JOIN w b ON a.category = b.category AND a.number = b.number AND a.grp < b.grp")
def studentised_ranges(spark, sf_dir):
    return rounded(groups.pairwise_differences(groups.group_moments(_line_groups(spark, sf_dir))), 6, q=5)


# Tables of counts

_CELLS = """c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n, x.r * y.c * 1.0 / t.n AS e FROM (SELECT a, sum(n) AS r FROM c GROUP BY a) x CROSS JOIN (SELECT b, sum(n) AS c FROM c GROUP BY b) y
CROSS JOIN (SELECT sum(n) AS n FROM c) t LEFT JOIN c ON c.a = x.a AND c.b = y.b), s AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(DISTINCT a) AS n_rows, count(DISTINCT b) AS n_columns, sum((n - e) ** 2 / e) AS s, count(CASE WHEN e < 5 THEN 1 END) AS low, min(e) AS least FROM e)"""


@query(f"WITH {_CELLS}, d AS (SELECT *, ((n_rows - 1) * (n_columns - 1))::DOUBLE AS df FROM s) SELECT n, round({sql_p_chi2('s', 'df')}, 6) AS p, CASE WHEN low = 0 THEN 'yes' WHEN n_rows = 2 AND n_columns = 2 THEN 'careful: expected counts below 5; see Fisher''s p' ELSE 'careful: expected counts below 5' END AS reliable FROM d")
def chi_square_tests(spark, sf_dir):
    t = contingency.chi_square_p(contingency.chi_square(contingency.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")))
    return rounded(t.select("n", "p", contingency.label_chi_square(F.col("low_expected"), F.col("n_rows"), F.col("n_columns")).alias("reliable")))


@query(f"WITH {_CELLS} SELECT n, n_rows, n_columns, round(least, 6) AS least_expected FROM s")
def least_expected(spark, sf_dir):
    return rounded(contingency.least_expected(contingency.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")))


_WK = "SELECT CAST(l_linenumber AS VARCHAR) AS a, CAST(l_orderkey % 7 + 1 AS VARCHAR) AS b FROM lineitem"


@query(f"""WITH x AS ({_WK}), c AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT count(*) AS n FROM x), ra AS (SELECT a, count(*) AS r FROM x GROUP BY a), rb AS (SELECT b, count(*) AS r FROM x GROUP BY b),
o AS (SELECT sum(abs(a::INT - b::INT) * n) AS w FROM c), e AS (SELECT sum(abs(a::INT - b::INT) * ra.r * rb.r * 1.0 / t.n) AS w FROM ra, rb, t) SELECT t.n AS n, round(1 - o.w / e.w, 8) AS weighted_kappa FROM t, o, e""")
def weighted_kappa(spark, sf_dir):
    pair = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("a"), (F.col("l_orderkey") % 7 + 1).cast("string").alias("b"))
    return rounded(contingency.agreement(pair, "a", "b").select("n", "weighted_kappa"), 8)


@query(f"SELECT variable, round(statistic, 4) AS statistic, df, round({sql_p_chi2('statistic', 'df')}, 6) AS p FROM (SELECT variable, sum((n - e) * (n - e) / e) AS statistic, count(*) - 1 AS df FROM (SELECT variable, n, sum(n) OVER (PARTITION BY variable) * 1.0 / count(*) OVER (PARTITION BY variable) AS e FROM ({_FREQ})) GROUP BY variable)")
def equal_share_tests(spark, sf_dir):
    return rounded(describe.with_p(describe.equal_shares(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])), 6, statistic=4)


# Scales, ROC, curves


@query(f"""WITH x AS ({_ITEM_ROWS}), a AS (SELECT 8.0 / 7 * (1 - ({" + ".join(f"var_samp({c})" for c in ITEMS)}) / var_samp({_TOTAL})) AS a FROM x)
SELECT 'item' AS name, round(a, 7) AS alpha, CASE WHEN a < 0.5 THEN 'unacceptable' WHEN a < 0.6 THEN 'poor' WHEN a < 0.7 THEN 'questionable' WHEN a < 0.8 THEN 'acceptable' WHEN a < 0.9 THEN 'good' ELSE 'excellent' END AS label FROM a""")
def alpha_labels(spark, sf_dir):
    r = scale.reliability(_items(spark, sf_dir), {"item": ITEMS})
    return rounded(r.select("name", "alpha", scale.label_alpha(F.col("alpha")).alias("label")), 7)


@query("SELECT regexp_replace(name, '[\\s_\\-.]*\\d+$', '') AS stem, count(*) AS k FROM (SELECT unnest(['item_1', 'item_2', 'item_3', 'item_4', 'item_5', 'item_6', 'item_7', 'item_8', 'label']) AS name) WHERE name <> 'label' AND (SELECT count(*) FROM embeddings) > 0 GROUP BY stem HAVING count(*) >= 3")
def item_groups(spark, sf_dir):
    rows = _items(spark, sf_dir)
    found = [(stem, len(items)) for stem, items in scale.item_groups(rows.columns).items()]
    return spark.createDataFrame(found, "stem string, k long").join(rows.limit(1).select(F.lit(True).alias("_any")), how="cross").drop("_any")


_AUC = """WITH s AS (SELECT quality AS y, n_chars AS v FROM documents JOIN labels ON documents.doc_id = labels.doc_id), r AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM s),
a AS (SELECT CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS r1 FROM r), b AS (SELECT *, (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS raw FROM a), c AS (SELECT *, greatest(raw, 1 - raw) AS auc FROM b),
d AS (SELECT *, sqrt((auc * (1 - auc) + (n1 - 1) * (auc / (2 - auc) - auc * auc) + (n0 - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n1 * n0)) AS se FROM c)"""


@query(f"""{_AUC} SELECT 'n_chars' AS score, round(auc, 8) AS auc, round(se, 8) AS se, round(greatest(0, auc - 1.96 * se), 8) AS ci_low, round(least(1, auc + 1.96 * se), 8) AS ci_high,
CASE WHEN auc < 0.6 THEN 'none' WHEN auc < 0.7 THEN 'poor' WHEN auc < 0.8 THEN 'acceptable' WHEN auc < 0.9 THEN 'good' ELSE 'excellent' END AS label FROM d""")
def roc_labels(spark, sf_dir):
    found = regress.roc_auc(_scored(spark, sf_dir), "quality", ["n_chars"])
    return rounded(found.select("score", "auc", "se", "ci_low", "ci_high", regress.label_auc(F.col("auc")).alias("label")), 8)


_POLY = "SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part"


@query(f"""WITH p AS ({_POLY}), c AS (SELECT avg(x) AS mx, avg(y) AS my FROM p), z AS (SELECT x - mx AS u, y - my AS v FROM p, c), m AS (SELECT count(*) AS n, avg(u * u) AS s2, avg(u ** 3) AS s3, avg(u ** 4) AS s4, avg(u * v) AS t1, avg(u * u * v) AS t2, avg(v * v) AS vv FROM z),
b AS (SELECT n, s2, vv, (t2 * s2 - t1 * s3) / (s4 * s2 - s3 * s3 - s2 * s2 * s2) AS b2, s2, s3, t1 FROM m), r AS (SELECT n, vv, b2, (t1 - b2 * s3) / s2 AS b1, -b2 * s2 AS b0, s2 FROM b)
SELECT 'quadratic' AS model, r.n AS n, round(sum((v - b0 - b1 * u - b2 * u * u) ** 2), 1) AS sse FROM z, r GROUP BY r.n""")
def quadratic_fit(spark, sf_dir):
    fits = curves.fit_curves(table(spark, sf_dir, "part"), "p_size", "p_retailprice").where("model = 'quadratic'")
    return rounded(fits.select("model", "n", "sse"), 1)


def _g4(x: str) -> str:
    """Four significant digits in SQL, for numbers from 0.001 to a million."""
    digits = f"greatest(0, 3 - floor(log10(abs({x})))::INT)"
    return f"(CASE WHEN round(abs({x}), {digits}) = floor(round(abs({x}), {digits})) THEN CAST(CAST(round({x}, {digits}) AS BIGINT) AS VARCHAR) ELSE CAST(round({x}, {digits}) AS VARCHAR) END)"


@query(f"""WITH l AS (SELECT 'linear' AS model, regr_intercept(v, u) AS a, regr_slope(v, u) AS b FROM (SELECT l_quantity AS u, l_extendedprice / 100 AS v FROM lineitem) UNION ALL SELECT 'logarithmic', regr_intercept(v, ln(u)), regr_slope(v, ln(u)) FROM (SELECT l_quantity AS u, l_extendedprice / 100 AS v FROM lineitem))
SELECT model, 'price = ' || {_g4('a')} || CASE WHEN b >= 0 THEN ' + ' ELSE ' − ' END || {_g4('abs(b)')} || CASE WHEN model = 'linear' THEN '·quantity' ELSE '·ln(quantity)' END AS equation FROM l""")
def equations(spark, sf_dir):
    fits = curves.fit_curves(table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 100).alias("price")), "l_quantity", "price").where("model in ('linear', 'logarithmic')")
    return fits.select("model", curves.equation("price", "quantity", F.col("model"), F.col("coefficients")).alias("equation"))


# Corrections and findings

_TESTS = "SELECT l_returnflag AS family, CAST(l_linenumber AS VARCHAR) AS id, (sum(l_orderkey) * 7919 % 100003) / 100003.0 AS p FROM lineitem WHERE l_returnflag <> 'R' OR l_linenumber = 1 GROUP BY ALL"


@query(f"""WITH t AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS i FROM ({_TESTS})),
h AS (SELECT family, id, p, CASE WHEN m < 2 THEN p ELSE max(least(1, p * (m - i + 1))) OVER (PARTITION BY family ORDER BY i) END AS a FROM t) SELECT family, id, round(p, 9) AS p, round(a, 9) AS p_adjusted, a < 0.3 AND id <> '2' AS significant FROM h""")
def family_verdicts(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R' or l_linenumber = 1")
    tests = line.groupBy(F.col("l_returnflag").alias("family"), F.col("l_linenumber").cast("string").alias("id")).agg(((F.sum("l_orderkey") * 7919 % 100003) / 100003).alias("p"))
    done = adjust.family_adjust(tests, "holm").withColumn("error", F.when(F.col("id") == "2", "failed"))
    return rounded(findings.significant(done, 0.3).drop("error"), 9)


_PLAN = [(1, "group", "l_quantity", "l_returnflag", "anova"), (2, "group", "l_discount", "l_linestatus", "welch_t"), (3, "group", "l_discount", "l_returnflag", "kruskal_wallis"), (4, "correlation", "l_quantity", "l_tax", "pearson"), (5, "correlation", "l_tax", "l_discount", "spearman"), (6, "association", "l_linestatus", "l_returnflag", "chi_square")]
_CHI = """cc AS (SELECT l_linestatus AS a, l_returnflag AS b, count(*) AS n FROM lineitem GROUP BY ALL), ce AS (SELECT x.a, y.b, coalesce(cc.n, 0) AS n, x.r * y.c * 1.0 / t.n AS e FROM (SELECT a, sum(n) AS r FROM cc GROUP BY a) x CROSS JOIN (SELECT b, sum(n) AS c FROM cc GROUP BY b) y CROSS JOIN (SELECT sum(n) AS n FROM cc) t LEFT JOIN cc ON cc.a = x.a AND cc.b = y.b),
cs AS (SELECT sum(n)::BIGINT AS n, sum((n - e) ** 2 / e) AS s, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS df FROM ce)"""


@query(f"""WITH {_F}, {_TWO.replace(_MOMENTS + ', ', '').replace('t AS (SELECT *, d / sqrt', 'tw AS (SELECT *, d / sqrt')}, {_RANKS}, {_CHI}, kt AS (SELECT rs.category, rs.number, ties, count(*)::DOUBLE AS k, CAST(sum(n) AS DOUBLE) AS n, sum(rank_sum * rank_sum / n) AS part FROM rs JOIN ti ON rs.category = ti.category AND rs.number = ti.number GROUP BY rs.category, rs.number, ties),
kh AS (SELECT category, number, n, k, k - 1 AS df, (12 / (n * (n + 1)) * part - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM kt),
pr AS (SELECT count(*) AS n, (count(*) - 2)::DOUBLE AS df, corr(l_quantity, l_tax) AS r, corr(l_quantity, l_tax) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_tax) ** 2)) AS t FROM lineitem),
sk AS (SELECT rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS y FROM lineitem),
sp AS (SELECT count(*) AS n, (count(*) - 2)::DOUBLE AS df, corr(x, y) AS r, corr(x, y) * sqrt((count(*) - 2) / (1 - corr(x, y) ** 2)) AS t FROM sk),
u AS (SELECT 'F1' AS id, 'group' AS family, n::BIGINT AS n, f AS statistic, {sql_p_f('f', 'd1', 'd2')} AS p, e AS effect FROM f WHERE category = 'l_returnflag' AND number = 'l_quantity'
UNION ALL SELECT 'F2', 'group', n1 + n2, wt, {sql_p_t('wt', 'wdf')}, cd FROM tw WHERE number = 'l_discount' UNION ALL SELECT 'F3', 'group', n::BIGINT, h, {sql_p_chi2('h', 'df')}, (h - k + 1) / (n - k) FROM kh WHERE category = 'l_returnflag' AND number = 'l_discount'
UNION ALL SELECT 'F4', 'correlation', n, r, {sql_p_t('t', 'df')}, r FROM pr UNION ALL SELECT 'F5', 'correlation', n, r, {sql_p_t('t', 'df')}, r FROM sp UNION ALL SELECT 'F6', 'association', n, s, {sql_p_chi2('s', 'df')}, sqrt(s / n) FROM cs),
w AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS i FROM u), a AS (SELECT *, CASE WHEN m < 2 THEN p ELSE max(least(1, p * (m - i + 1))) OVER (PARTITION BY family ORDER BY i) END AS pa FROM w)
SELECT id, n, round(statistic, 4) AS statistic, round(p, 5) AS p, round(effect, 6) AS effect, round(pa, 5) AS p_adjusted, pa < 0.05 AS significant FROM a""")
def plan_findings(spark, sf_dir):
    plan = spark.createDataFrame([(*p, None) for p in _PLAN], "number int, family string, dv string, iv string, test string, extra array<string>")
    found = findings.run_plan(table(spark, sf_dir, "lineitem"), plan)
    return rounded(found.select("id", "n", "statistic", "p", "effect", "p_adjusted", "significant"), 5, statistic=4, effect=6)


@query()
def planned_findings(spark, sf_dir):
    """The whole way of one table: kinds, checks, plan, tests, corrections."""
    orders = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority")
    plan = base._planned(orders, "o_totalprice")
    return rounded(findings.run_plan(orders, plan), 8)


# Display: labels, keywords, formats, summaries

_NAMES = "SELECT 'o_' || lower(r_name) AS variable, 'Region ' || r_name AS label FROM region"


@query("SELECT n_nationkey, coalesce(r_name, CAST(n_regionkey AS VARCHAR)) AS n_regionkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2")
def decoded_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.lit("n_regionkey").alias("variable"), F.col("r_regionkey").cast("string").alias("value"), F.col("r_name").alias("label"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("double").alias("n_regionkey"))  # codes of a table of numbers: 2.0
    decoded = tables.decode_labels(nation, labels, ["n_regionkey"])
    return decoded.select("n_nationkey", F.regexp_replace("n_regionkey", r"\.0$", "").alias("n_regionkey"))


@query(f"WITH v AS ({_NAMES}) SELECT n_nationkey, coalesce(label, 'o_' || lower(n_name)) AS variable FROM nation LEFT JOIN v ON v.variable = CASE WHEN n_nationkey % 2 = 0 THEN (SELECT 'o_' || lower(r_name) FROM region WHERE r_regionkey = n_regionkey) END".replace("'o_' || lower(n_name)", "CASE WHEN n_nationkey % 2 = 0 THEN (SELECT 'o_' || lower(r_name) FROM region WHERE r_regionkey = n_regionkey) ELSE 'o_' || lower(n_name) END"))
def display_names(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    variables = region.select(F.concat(F.lit("o_"), F.lower("r_name")).alias("variable"), F.concat(F.lit("Region "), "r_name").alias("label"))
    own = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("o_"), F.lower(F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.col("n_name")))).alias("variable"))
    return tables.named(own, variables, ["variable"])


@query("""WITH k AS (SELECT n_nationkey, list_filter(['Region ' || r_name, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'extra' END], lambda x: x IS NOT NULL) AS ks FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, array_to_string(ks, '|') AS keywords, array_to_string(ks[1:3], ' ') || '|' || ks[1] || ' ' || ks[2] || ' relationship' AS queries FROM k""")
def finding_keywords(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("dv"), F.col("n_name").alias("iv"), F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("extra"))).alias("extra"))
    labels = region.select(F.concat(F.lit("r"), "r_regionkey").alias("variable"), F.concat(F.lit("Region "), "r_name").alias("label"))
    found = records.keywords(rows, labels)
    return found.select("n_nationkey", F.array_join("keywords", "|").alias("keywords"), F.array_join("queries", "|").alias("queries"))


@query("""SELECT p_partkey, CASE WHEN p < 0.001 THEN 'p < .001' ELSE 'p = ' || replace(printf('%.3f', p), '0.', '.') END AS p_text, printf('%.2f', p_retailprice) AS statistic, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE printf('%.1f', p_size + 0.3) END || ', ' || CAST(p_size AS VARCHAR) AS df
FROM (SELECT p_partkey, p_retailprice, p_size, (p_partkey % 997) / 1000.0 AS p FROM part)""")
def number_formats(spark, sf_dir):
    from ..operators.planning import format_df, format_p, format_statistic

    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", format_p((F.col("p_partkey") % 997) / F.lit(1000.0)).alias("p_text"), format_statistic(F.col("p_retailprice")).alias("statistic"),
        format_df(F.array(F.when(F.col("p_size") % 2 == 0, size).otherwise(size + 0.3), size)).alias("df"),
    )


@query("""SELECT p_partkey, '''' || p_brand || ''' ' || CASE WHEN p < 0.05 THEN 'differed significantly' ELSE 'did not differ significantly' END || ' across ''' || p_type || ''' groups (F(2, ' || CAST(p_size + 10 AS VARCHAR) || ') = ' || printf('%.2f', p_retailprice) || ', '
|| CASE WHEN p < 0.001 THEN 'p < .001' ELSE 'p = ' || replace(printf('%.3f', p), '0.', '.') END || ', η² = ' || printf('%.2f', p_size / 100.0) || ').' AS sentence FROM (SELECT *, (p_partkey % 997) / 1000.0 AS p FROM part)""")
def result_sentences(spark, sf_dir):
    from ..operators.planning import result_sentence

    p = (F.col("p_partkey") % 997) / F.lit(1000.0)
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.lit("group").alias("family"), F.lit("anova").alias("test"), F.col("p_brand").alias("dv"), F.col("p_type").alias("iv"), F.col("p_retailprice").alias("statistic"), F.array(F.lit(2.0), (F.col("p_size") + 10).cast("double")).alias("df"), p.alias("p"), p.alias("p_adjusted"),
        (F.col("p_size") / 100).alias("effect"), F.lit("η²").alias("effect_name"), F.lit(None).cast("double").alias("r2"), (p < 0.05).alias("significant"),
    )
    return result_sentence(rows).select("p_partkey", "sentence")


@query("SELECT 'pairs' AS name, 6::BIGINT AS n_rows, 9::BIGINT AS n_columns, 54::BIGINT AS n_cells FROM lineitem HAVING count(*) > 4 UNION ALL SELECT 'frequencies', count(*), 5, count(*) * 5 FROM (" + _FREQ + ")")
def run_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return report.run_summary({"pairs": correlate.pearson_pairs(lines, LINE), "frequencies": describe.frequencies(lines, ["l_returnflag", "l_linestatus"])})


@query("SELECT count(*) AS n, (6 * CAST(floor(count(*) * log2(count(*))) AS BIGINT) + 3 * (3200 * count(*) + 5 * 5 * count(*)) + 250 * count(*) * 4 + 100 * count(*) + 64)::BIGINT AS steps FROM lineitem")
def work_estimate(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))
    n = counted.first()[0]
    return counted.withColumn("steps", F.lit(report.work_estimate(n, 4, 2, 3, True)).cast("long"))


@query(f"""WITH c AS ({_pearson_sql('lineitem', _pairs(LINE))}), f AS (SELECT category, number, ssb / (ssb + ssw) AS e FROM (WITH {_MOMENTS}, {_ANOVA} SELECT * FROM s))
SELECT 'correlation' AS kind, row_number() OVER (ORDER BY abs(r) DESC)::INT AS rank, a || ' and ' || b AS text FROM c QUALIFY rank <= 2 UNION ALL SELECT 'groups', row_number() OVER (ORDER BY e DESC)::INT AS rank, number || ' by ' || category FROM f QUALIFY rank <= 3""")
def highlights(spark, sf_dir):
    pairs = correlate.pearson_pairs(table(spark, sf_dir, "lineitem"), LINE).withColumn("size", F.abs("r"))
    tests = groups.anova(groups.group_moments(_line_groups(spark, sf_dir)))
    return report.highlights({"correlation": (pairs, "size", 2, "a || ' and ' || b"), "groups": (tests, "eta2", 3, "number || ' by ' || category")})


# Records and markers


@query("SELECT doc_id, source || ' paper' AS title, CAST(1990 + doc_id % 30 AS INT) AS year, 'Ann ' || upper(lang) AS author, n_chars AS cited_by FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def flattened_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    dated = F.when(F.col("doc_id") % 2 == 0, F.struct(F.array(F.array((1990 + F.col("doc_id") % 30).cast("int"))).alias("date-parts")))
    raw = F.to_json(F.struct(
        F.array(F.concat("source", F.lit(" paper"))).alias("title"), dated.alias("published-print"), F.struct(F.array(F.array((1990 + F.col("doc_id") % 30).cast("int"))).alias("date-parts")).alias("issued"),
        F.array(F.struct(F.lit("Ann").alias("given"), F.upper("lang").alias("family"))).alias("author"), F.col("n_chars").cast("long").alias("is-referenced-by-count"),
    ))
    return bibliography.flatten_items(d.select("doc_id", raw.alias("raw")), "raw").select("doc_id", "title", "year", F.col("authors")[0].alias("author"), F.col("cited_by").cast("long").alias("cited_by"))


@query("SELECT doc_id, 'On ' || source AS title, CAST(1990 + doc_id % 30 AS INT) AS year, 'Ann Lee' AS author FROM documents WHERE source IS NOT NULL AND doc_id % 5 <> 0")
def flattened_articles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null")
    xml = F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"), F.lit("</PMID><Article><Journal><Title>J</Title><JournalIssue><Volume>1</Volume><Issue>2</Issue><PubDate><Year>"), (1990 + F.col("doc_id") % 30).cast("string"),
        F.lit("</Year></PubDate></JournalIssue></Journal><ArticleTitle>On "), "source", F.lit("</ArticleTitle><AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"),
    )
    broken = F.when(F.col("doc_id") % 5 == 0, "<PubmedArticleSet><broken").otherwise(xml)
    return bibliography.flatten_articles(d.select("doc_id", broken.alias("raw")), "raw").select("doc_id", "title", "year", F.col("authors")[0].alias("author"))


@query(f"""WITH t AS ({_MARKED}), m AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda x: regexp_split_to_array(x, '\\s*,\\s*'))) AS ids FROM t), e AS (SELECT doc_id, unnest(ids)::BIGINT AS id FROM m)
SELECT doc_id, id, count(*) AS n FROM e WHERE id NOT IN (SELECT r_regionkey FROM region) GROUP BY ALL""")
def invalid_markers(spark, sf_dir):
    known = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    return records.invalid_markers(records.markers(_marked(spark, sf_dir), "doc_id", "text"), known).groupBy("doc_id", "id").agg(F.count("*").alias("n"))


_CITED = "SELECT doc_id, 'As said (Smith et al., ' || CAST(1990 + doc_id % 30 AS VARCHAR) || ') and (Lee, 20' || CAST(10 + doc_id % 9 AS VARCHAR) || 'a) and (' || lang || ', 2001).' AS text FROM documents WHERE lang IS NOT NULL"


@query(f"SELECT doc_id, '(Smith et al., ' || CAST(1990 + doc_id % 30 AS VARCHAR) || ')' AS citation FROM ({_CITED}) UNION ALL SELECT doc_id, '(Lee, 20' || CAST(10 + doc_id % 9 AS VARCHAR) || 'a)' FROM ({_CITED})")
def loose_citations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null")
    text = F.concat(F.lit("As said (Smith et al., "), (1990 + F.col("doc_id") % 30).cast("string"), F.lit(") and (Lee, 20"), (10 + F.col("doc_id") % 9).cast("string"), F.lit("a) and ("), "lang", F.lit(", 2001)."))
    return records.loose_citations(d.select("doc_id", text.alias("text")), "doc_id", "text")


_N_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, {_N_WORDS.format('text')}::INT AS n_before, {_N_WORDS.format('left(text, n_chars // 2)')}::INT AS n_after FROM documents WHERE text IS NOT NULL AND {_N_WORDS.format('text')} >= 30 AND {_N_WORDS.format('left(text, n_chars // 2)')} < 0.6 * {_N_WORDS.format('text')}")
def collapsed_edits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    after = d.select("doc_id", F.substring(F.col("text"), F.lit(1), F.expr("cast(n_chars div 2 as int)")).alias("text"))
    return records.collapsed(d.select("doc_id", "text"), after, "doc_id", "text")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 50 <> 7 AND doc_id % 7 <> 7 AND text IS NOT NULL")
def changed_markers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", (F.col("doc_id") % 50).cast("string").alias("m"))
    before = d.select("doc_id", F.concat(F.lit("said [7, "), "m", F.lit("]")).alias("text"))
    after = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "said [7]").otherwise(F.concat(F.lit("said ["), "m", F.lit("] and [7]"))).alias("text"))
    return records.changed_markers(before, after, "doc_id", "text")


@query("""WITH q AS (SELECT doc_id, '.' || lpad(CAST(doc_id % 100 AS VARCHAR), 3, '0') AS quoted FROM documents), f AS (SELECT DISTINCT regexp_replace(printf('%.' || d || 'f', (p_partkey % 40) / 1000.0), '^0', '') AS form FROM part, (SELECT unnest([2, 3]) AS d)) SELECT doc_id, quoted FROM q WHERE quoted NOT IN (SELECT form FROM f)""".replace("printf('%.' || d || 'f', (p_partkey % 40) / 1000.0)", "CASE WHEN d = 2 THEN printf('%.2f', (p_partkey % 40) / 1000.0) ELSE printf('%.3f', (p_partkey % 40) / 1000.0) END"))
def unmatched_p_values(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("It held (p = ."), F.lpad((F.col("doc_id") % 100).cast("string"), 3, "0"), F.lit("), p < .001.")).alias("text"))
    known = table(spark, sf_dir, "part").select(((F.col("p_partkey") % 40) / F.lit(1000.0)).alias("p"))
    return records.unmatched_p_values(texts, "doc_id", "text", known)


@query("SELECT unnest(['ASIA', 'methods', 'EUROPE']) AS r_name EXCEPT SELECT r_name FROM region WHERE r_name <> 'EUROPE'")
def missing_sections(spark, sf_dir):
    texts = table(spark, sf_dir, "region").select("r_name", F.when(F.col("r_name") == "EUROPE", "  ").otherwise(F.col("r_name")).alias("text"))
    return records.missing_sections(texts, "r_name", "text", ["ASIA", "methods", "EUROPE"])


_RECORDS = "SELECT p_partkey AS seq, CASE WHEN p_partkey % 4 <> 0 THEN '10.2/' || CAST(p_partkey % 60 AS VARCHAR) END AS doi, p_name AS title, CASE WHEN p_partkey % 7 <> 0 THEN CAST(2000 + p_size % 24 AS INT) END AS year, p_size AS cited_by FROM part"


def _records(spark, sf_dir):
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.cast("long").alias("seq"), F.when(p % 4 != 0, F.concat(F.lit("10.2/"), (p % 60).cast("string"))).alias("doi"), F.col("p_name").alias("title"), F.when(p % 7 != 0, (2000 + F.col("p_size") % 24).cast("int")).alias("year"), F.col("p_size").alias("cited_by"),
    )


_SCORE = """2 * len(list_intersect(['green', 'blue', 'small', 'part'], regexp_extract_all(lower(title), '[a-zçğıöşü]+'))) / 4.0 + ln(1 + cited_by) / 10 + coalesce(least(1, greatest(0, 1 - (2025 - year) / 20.0)), 0) + CASE WHEN seq % 2 = 0 THEN 0.5 ELSE 0 END"""


@query(f"SELECT seq, round({_SCORE}, 8) AS score FROM ({_RECORDS})")
def relevance(spark, sf_dir):
    r = _records(spark, sf_dir)
    terms = F.array(*[F.lit(w) for w in ("green", "blue", "small", "part")])
    return rounded(r.select("seq", records.relevance(terms, F.col("title"), F.col("cited_by"), F.col("year"), F.when(F.col("seq") % 2 == 0, "abstract"), 2025).alias("score")), 8)


_KEYED = f"SELECT 'F' || CAST(seq % 4 AS VARCHAR) AS target, coalesce(lower(doi), 't:' || substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 80)) AS key, seq, cited_by + (seq % 97) / 100.0 AS score FROM ({_RECORDS})"
_CHOSEN = f"""b AS (SELECT target, key, max(score) AS score FROM ({_KEYED}) GROUP BY ALL), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, key) AS rank FROM b) WHERE rank <= 5),
g AS (SELECT key, max(score) AS score FROM c GROUP BY key), ids AS (SELECT row_number() OVER (ORDER BY score DESC, key) AS id, key, score FROM g)"""


def _candidates(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select(F.concat(F.lit("F"), (F.col("seq") % 4).cast("string")).alias("target"), records.record_key(F.col("doi"), F.col("title")).alias("key"), "seq", "title", (F.col("cited_by") + (F.col("seq") % 97) / F.lit(100.0)).alias("score"))


@query(f"WITH {_CHOSEN} SELECT c.target, ids.id, ids.key, round(ids.score, 6) AS score FROM c JOIN ids ON c.key = ids.key")
def selected_references(spark, sf_dir):
    references, links = records.select_references(_candidates(spark, sf_dir))
    return rounded(links.join(references, "id").select("target", "id", "key", "score"))


@query(f"WITH {_CHOSEN} SELECT c.target, ids.id FROM c JOIN ids ON c.key = ids.key UNION ALL SELECT 'INTRO', id FROM ids WHERE id <= 8")
def references_of_findings(spark, sf_dir):
    references, links = records.select_references(_candidates(spark, sf_dir))
    targets = links.select("target").distinct().unionByName(links.limit(1).select(F.lit("INTRO").alias("target")))
    return records.references_of(links, references, targets).select("target", "id")


_EXCLUDE = "coalesce(doi, 't:' || lower(substr(title, 1, 60)))"


@query(f"""WITH r AS ({_RECORDS}), known AS (SELECT seq AS id, {_EXCLUDE} AS key FROM r WHERE seq <= 30), n AS (SELECT {_EXCLUDE} AS key, min(seq) AS seq FROM r WHERE seq > 30 AND {_EXCLUDE} NOT IN (SELECT key FROM known) GROUP BY 1)
SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY n.seq) AS id, r.doi, r.title FROM n JOIN r ON n.seq = r.seq""")
def added_references(spark, sf_dir):
    r = _records(spark, sf_dir)
    existing = r.where("seq <= 30").select(F.col("seq").alias("id"), "doi", "title")
    return records.added_references(r.where("seq > 30"), existing)


_AUTHORS = "CASE WHEN seq % 5 = 0 THEN []::VARCHAR[] WHEN seq % 5 = 1 THEN ['Ann Lee'] WHEN seq % 5 = 2 THEN ['Bo van Dam', 'Ann Lee'] ELSE ['Cy', 'Ann B. Lee', 'Bo Dam'] END"


def _authored(spark, sf_dir):
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    k = F.col("seq") % 5
    authors = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, names("Ann Lee")).when(k == 2, names("Bo van Dam", "Ann Lee")).otherwise(names("Cy", "Ann B. Lee", "Bo Dam"))
    return _records(spark, sf_dir).withColumn("authors", authors)


@query(f"SELECT count(*) AS n, count(*) - count(year) AS without_year, count(CASE WHEN len(authors) = 0 THEN 1 END) AS without_authors, count(CASE WHEN len(authors) = 0 OR year IS NULL THEN 1 END) AS incomplete FROM (SELECT *, {_AUTHORS} AS authors FROM ({_RECORDS}))")
def incomplete_references(spark, sf_dir):
    return records.incomplete(_authored(spark, sf_dir))


@query(f"SELECT seq, CASE WHEN seq % 5 = 0 THEN 'zzz' WHEN seq % 5 = 1 THEN 'lee' WHEN seq % 5 = 2 THEN 'dam' ELSE 'cy' END AS name, row_number() OVER (ORDER BY CASE WHEN seq % 5 = 0 THEN 'zzz' WHEN seq % 5 = 1 THEN 'lee' WHEN seq % 5 = 2 THEN 'dam' ELSE 'cy' END, coalesce(year, 0), seq)::INT AS place FROM ({_RECORDS}) WHERE seq <= 100")
def reference_order(spark, sf_dir):
    from pyspark.sql import Window

    listed = _authored(spark, sf_dir).where("seq <= 100")  # the references of one manuscript
    keys = records.list_order(F.col("authors"), F.col("year"))
    return listed.select("seq", keys[0].alias("name"), F.row_number().over(Window.orderBy(*keys, "seq")).alias("place"))


_APA = "CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 5 = 1 THEN 'Lee, A.' WHEN seq % 5 = 2 THEN 'Dam, B. v., & Lee, A.' ELSE 'Cy, Lee, A. B., & Dam, B.' END"


@query(f"""SELECT seq, CASE WHEN a IS NULL THEN rtrim(title, '.') || '. ' || y ELSE a || ' ' || y || ' ' || rtrim(title, '.') || '.' END || ' Journal, 7(' || CAST(cited_by AS VARCHAR) || '), 1-9.' || CASE WHEN doi IS NOT NULL THEN ' https://doi.org/' || doi ELSE ' https://pubmed.ncbi.nlm.nih.gov/' || CAST(seq AS VARCHAR) || '/' END AS reference
FROM (SELECT *, {_APA.replace("B. v.", "B. V.")} AS a, coalesce('(' || CAST(year AS VARCHAR) || ').', '(t.y.).') AS y FROM ({_RECORDS}))""")
def apa_references(spark, sf_dir):
    r, c = _authored(spark, sf_dir), F.col
    text = records.apa_reference(c("authors"), c("year"), c("title"), F.lit("Journal"), F.lit("7"), c("cited_by").cast("string"), F.lit("1-9"), c("doi"), c("seq").cast("string"))
    return r.select("seq", text.alias("reference"))


@query(f"""SELECT seq, CASE WHEN seq % 5 = 0 THEN '“' || substr(title, 1, 30) || CASE WHEN length(title) > 30 THEN '…' ELSE '' END || '”' WHEN seq % 5 = 1 THEN 'Lee' WHEN seq % 5 = 2 THEN 'Dam & Lee' ELSE 'Cy et al.' END || ', ' || coalesce(CAST(year AS VARCHAR), 'n.d.') AS label FROM ({_RECORDS})""")
def in_text_labels(spark, sf_dir):
    return _authored(spark, sf_dir).select("seq", records.in_text_label(F.col("authors"), F.col("year"), F.col("title")).alias("label"))


@query("""WITH t AS (SELECT doc_id, list_distinct(list_sort([doc_id % 9, doc_id % 5])) AS old FROM documents), k AS (SELECT DISTINCT unnest(old) AS old FROM t) SELECT doc_id, 'as [' || array_to_string(list_sort(list_transform(old, lambda x: x + 10)), ', ') || '] said' AS text FROM t""")
def renumbered_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    texts = d.select("doc_id", F.concat(F.lit("as ["), (F.col("doc_id") % 9).cast("string"), F.lit(", "), (F.col("doc_id") % 5).cast("string"), F.lit("] said")).alias("text"))
    numbers = d.select((F.col("doc_id") % 9).cast("long").alias("old")).distinct().withColumn("new", F.col("old") + 10)
    return records.renumber(texts, "doc_id", "text", numbers).select("doc_id", "text")


# SQL for queries of the first module: their p values by the rules above


def _sql_of(name: str, sql: str, **digits: int) -> None:
    """Give a registered query its SQL, and round its result as the SQL does."""
    inner = base.QUERIES[name]

    def run(spark, sf_dir):
        return rounded(inner(spark, sf_dir), **digits)

    run.__name__, run.__doc__ = name, inner.__doc__
    base.QUERIES[name], base.SQL[name] = run, sql


_ORDER_K2 = _K2.replace(_G, f"SELECT 'o_totalprice' AS variable, count(*)::DOUBLE AS n, {_SKEW} AS g1, kurtosis_pop(v) AS g2 FROM (SELECT o_totalprice AS v FROM orders)")
_sql_of("normality_p", f"WITH {_ORDER_K2} SELECT variable, n, round(jb, 3) AS jarque_bera, round(z1, 4) AS z_skew, round(z2, 4) AS z_kurt, round(z1 * z1 + z2 * z2, 3) AS k2, round(exp(-jb / 2), 6) AS jb_p, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS k2_p FROM k4", jarque_bera=3, k2=3, z_skew=4, z_kurt=4)
_PART_LONG = "(SELECT 'p_size' AS variable, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part)"
_sql_of("mean_intervals", f"""WITH s AS (SELECT variable, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, stddev_samp(v) / sqrt(count(*)) AS se, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS min, max(v) AS max, {_SKEW} AS skewness, kurtosis_pop(v) AS kurtosis,
count(*) - 1.0 AS v, 1.959963984540054 AS z FROM {_PART_LONG} GROUP BY variable) SELECT variable, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(se, 6) AS se, round(median, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, min, max, round(max - min, 6) AS range,
round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(100 * sd / abs(mean), 6) AS cv_percent, round(mean - {_T975} * se, 5) AS ci_low, round(mean + {_T975} * se, 5) AS ci_high FROM s""", mean=5, sd=5, ci_low=5, ci_high=5)
_sql_of("two_groups_p", f"""WITH {_TWO} SELECT category, number, group_a, group_b, n1 + n2 AS n, round(t, 5) AS t, n1 + n2 - 2 AS df, round(wt, 5) AS welch_t, round(wdf, 3) AS welch_df, round(cd, 7) AS cohen_d, round(cd * (1 - 3.0 / (4 * (n1 + n2) - 9)), 7) AS hedges_g,
round({sql_p_t('t', 'df')}, 6) AS p, round({sql_p_t('wt', 'wdf')}, 6) AS welch_p FROM t""", t=5, welch_t=5, welch_df=3, cohen_d=7, hedges_g=7)
_sql_of("anova_p", f"WITH {_F} SELECT category, number, k, n::BIGINT AS n, round(f, 5) AS f, k - 1 AS df1, (n - k)::BIGINT AS df2, round(e, 8) AS eta2, round(wf, 5) AS welch_f, round(wd, 3) AS welch_df2, round({sql_p_f('f', 'd1', 'd2')}, 6) AS p, round({sql_p_f('wf', 'd1', 'wd')}, 6) AS welch_p FROM f", f=5, eta2=8, welch_f=5, welch_df2=3)


def _bh(source: str, family: str) -> str:
    """A table with p and its Bonferroni, Holm and Benjamini-Hochberg forms within the family."""
    over = f"PARTITION BY {family} ORDER BY i"
    return f"""(SELECT *, least(1, p * m) AS p_bonferroni, max(least(1, p * (m - i + 1))) OVER ({over}) AS p_holm, min(least(1, p * m / i)) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_bh
FROM (SELECT *, count(*) OVER (PARTITION BY {family}) AS m, row_number() OVER (PARTITION BY {family} ORDER BY p) AS i FROM {source}))"""


_SLOPES = _union([f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r, regr_slope({b}, {a}) AS slope, regr_intercept({b}, {a}) AS intercept FROM lineitem" for a, b in _pairs(LINE)])
_sql_of("correlations_adjusted", f"""WITH c AS ({_SLOPES}), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df, 0.5 * ln((1 + r) / (1 - r)) AS z, 1.96 / sqrt(n - 3) AS h FROM c), p AS (SELECT *, {sql_p_t('t', 'df')} AS p FROM t)
SELECT a, b, n, round(r, 7) AS r, round(tanh(z - h), 7) AS ci_low, round(tanh(z + h), 7) AS ci_high, round(slope, 4) AS slope, round(intercept, 2) AS intercept, {sql_strength('r')} AS strength, round(p, 5) AS p, round(p_bonferroni, 5) AS p_bonferroni, round(p_holm, 5) AS p_holm, round(p_bh, 5) AS p_bh, p_bh < 0.05 AS significant_bh FROM {_bh('p', '1')}""", r=7, ci_low=7, ci_high=7, slope=4, intercept=2, p=5, p_bonferroni=5, p_holm=5, p_bh=5)
_PAIRED = _union([f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, avg({a} - {b}) / stddev_samp({a} - {b}) AS dz FROM lineitem" for a, b in _pairs(LINE)])
_sql_of("significant_findings", f"""WITH {_F}, c AS ({_pearson_sql('lineitem', _pairs(LINE))}), ct AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM c), pd AS ({_PAIRED}), pt AS (SELECT *, dz * sqrt(n) AS t, n - 1 AS df FROM pd),
u AS (SELECT 'correlation' AS analysis, a AS first, b AS second, 'r' AS effect_name, r AS effect, {sql_p_t('t', 'df')} AS p FROM ct UNION ALL SELECT 'group', number, category, 'eta2', e, {sql_p_f('f', 'd1', 'd2')} FROM f UNION ALL SELECT 'paired', a, b, 'd_z', dz, {sql_p_t('t', 'df')} FROM pt)
SELECT analysis, first, second, effect_name, round(effect, 6) AS effect, round(p, 5) AS p, round(p_bonferroni, 5) AS p_bonferroni, round(p_holm, 5) AS p_holm, round(p_bh, 5) AS p_bh, true AS significant_bh FROM {_bh('u', 'analysis')} WHERE p_bh < 0.05""", p=5, p_bonferroni=5, p_holm=5, p_bh=5)
_KINDS = _union([f"SELECT '{c}' AS variable, {int(number)} AS number, {int(date)} AS date, count({c}) AS n, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS u, {f'bool_and({c}::DOUBLE % 1 = 0)' if number else 'false'} AS whole FROM orders" for c, number, date in (("o_orderkey", 1, 0), ("o_custkey", 1, 0), ("o_orderstatus", 0, 0), ("o_totalprice", 1, 0), ("o_orderdate", 0, 1), ("o_orderpriority", 0, 0))])
_sql_of("infer_kinds", f"""SELECT variable, CASE WHEN date = 1 THEN 'date' WHEN u <= 1 THEN 'excluded' WHEN n > 10 AND u = n AND (number = 0 OR whole) THEN 'id' WHEN number = 0 THEN CASE WHEN u = 2 THEN 'binary' WHEN u <= 12 THEN 'nominal' ELSE 'excluded' END
WHEN u = 2 THEN 'binary' WHEN whole AND u BETWEEN 3 AND 7 THEN 'ordinal' WHEN u > 7 THEN 'continuous' ELSE 'nominal' END AS kind, n, n_missing, u AS n_unique FROM ({_KINDS})""")
