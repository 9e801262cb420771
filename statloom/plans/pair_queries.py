"""Registered queries over all pairs of categories and all outcomes at once, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate, cube, curves, groups, neighbours, paired, regress, report
from .more_queries import sql_p_chi2, sql_p_t
from .queries import LINE, PARTS, _line_groups, _outcomes, query, rounded, table

_LINE_PAIRS = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber")]


def _cells(pairs: list[tuple[str, str]], source: str) -> str:
    one = "SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y, count(*) AS n FROM {s} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"
    return " UNION ALL ".join(one.format(a=a, b=b, s=source) for a, b in pairs)


#: Every level of a with every level of b, with the rows of both levels.
_FRAME = """
    rx AS (SELECT a, b, x, sum(n) AS r FROM cells GROUP BY ALL),
    cy AS (SELECT a, b, y, sum(n) AS c FROM cells GROUP BY ALL),
    frame AS (
        SELECT rx.a, rx.b, rx.x, cy.y, coalesce(cells.n, 0) AS n, r, c, sum(coalesce(cells.n, 0)) OVER (PARTITION BY rx.a, rx.b) AS total
        FROM rx JOIN cy ON rx.a = cy.a AND rx.b = cy.b
        LEFT JOIN cells ON cells.a = rx.a AND cells.b = rx.b AND cells.x = rx.x AND cells.y = cy.y)"""


@query(f"""
    WITH cells AS ({_cells(_LINE_PAIRS, "lineitem")}), {_FRAME},
    s AS (
        SELECT a, b, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT x) AS n_rows, count(DISTINCT y) AS n_columns,
            sum((n - r * c * 1.0 / total) ** 2 / (r * c * 1.0 / total)) AS statistic,
            count(CASE WHEN r * c * 1.0 / total < 5 THEN 1 END) AS low_expected, min(r * c * 1.0 / total) AS least_expected
        FROM frame GROUP BY a, b)
    SELECT a, b, n, n_rows, n_columns, round(statistic, 6) AS statistic, (n_rows - 1) * (n_columns - 1) AS df,
        round({sql_p_chi2("statistic", "((n_rows - 1) * (n_columns - 1))")}, 6) AS p,
        round(sqrt(statistic / (n * (least(n_rows, n_columns) - 1))), 8) AS cramer_v, low_expected, round(least_expected, 6) AS least_expected,
        CASE WHEN low_expected = 0 THEN 'yes' ELSE 'careful: expected counts below 5' END AS reliable
    FROM s""")
def association_pairs(spark, sf_dir):
    found = cube.association_pairs(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return rounded(found.drop("odds_ratio", "fisher_p", "reason"), 6, cramer_v=8)


#: Three raters of lines, with the same levels 1 to 7, and one with other levels.
_RATERS = "(SELECT CAST(l_linenumber AS VARCHAR) AS r1, CAST(l_orderkey % 7 + 1 AS VARCHAR) AS r2, CAST((l_orderkey + l_linenumber) % 7 + 1 AS VARCHAR) AS r3, l_returnflag AS other FROM lineitem)"


@query(f"""
    WITH cells AS ({_cells([("r1", "r2"), ("r1", "r3"), ("r2", "r3")], _RATERS)}), {_FRAME},
    s AS (
        SELECT a, b, CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN x = y THEN n ELSE 0 END) / sum(n) AS o, sum(CASE WHEN x = y THEN r * c * 1.0 / total ELSE 0 END) / sum(n) AS e,
            sum(abs(x::INT - y::INT) * n) AS wo, sum(abs(x::INT - y::INT) * r * c * 1.0 / total) AS we
        FROM frame GROUP BY a, b)
    SELECT a, b, n, '1, 2, 3, 4, 5, 6, 7' AS levels, round(o, 8) AS observed, round(e, 8) AS expected, round((o - e) / (1 - e), 8) AS kappa,
        CASE WHEN (o - e) / (1 - e) < 0.2 THEN 'slight' WHEN (o - e) / (1 - e) < 0.4 THEN 'fair' WHEN (o - e) / (1 - e) < 0.6 THEN 'moderate' WHEN (o - e) / (1 - e) < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS label,
        round(1 - wo / we, 8) AS weighted_kappa
    FROM s""")
def agreement_pairs(spark, sf_dir):
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    raters = table(spark, sf_dir, "lineitem").select(line.cast("string").alias("r1"), (order % 7 + 1).cast("string").alias("r2"), ((order + line) % 7 + 1).cast("string").alias("r3"), F.col("l_returnflag").alias("other"))
    found = cube.agreement_pairs(raters, ["r1", "r2", "r3", "other"])
    return rounded(found.select("a", "b", "n", "levels", "observed", "expected", "kappa", "label", "weighted_kappa"), 8)


@query(f"""
    WITH cells AS ({_cells([("quality", "toxic")], "labels")}), {_FRAME},
    t AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN x < y THEN n ELSE 0 END) AS up, sum(CASE WHEN x > y THEN n ELSE 0 END) AS down FROM frame GROUP BY a, b),
    m AS (SELECT *, CASE WHEN up + down < 25 THEN least(up, down) ELSE greatest(abs(up - down) - 1, 0) ** 2 / (up + down) END AS mcnemar FROM t)
    SELECT a, b, n, round(mcnemar, 8) AS mcnemar, round({sql_p_chi2("mcnemar", "1")}, 6) AS mcnemar_p FROM m""")
def change_pairs(spark, sf_dir):
    """More than 25 labels disagree at every size, so the chi-square form is the one that is compared; the exact form has a test."""
    found = cube.agreement_pairs(table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return rounded(found.select("a", "b", "n", "mcnemar", "mcnemar_p"), 8, mcnemar_p=6)


@query("""
    SELECT 'association: constant × ' || name AS test, 'one level' AS reason
    FROM (VALUES ('l_returnflag'), ('l_linestatus')) v(name) WHERE EXISTS (SELECT 1 FROM lineitem HAVING count(*) >= 5)""")
def skipped_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.lit("same").alias("constant"), "l_returnflag", "l_linestatus")
    return cube.skipped_pairs(cube.association_pairs(lines, lines.columns), "association")


@query()
def logistic_outcomes(spark, sf_dir):
    """Newton's method has no SQL; the test compares with single models."""
    outcomes = _outcomes(spark, sf_dir).withColumn("kilo_chars", F.col("n_chars") / 1000)
    return rounded(regress.logistic_all(outcomes, ["kilo_chars", "noise"], ["quality", "toxic", "lang"]))


_STATUS = "l_linestatus (O=1)"


def _moderated(y: str, x: str, z: str) -> str:
    """Sums of one model; columns are standardised over all lines, none of which misses a value."""
    return f"""SELECT '{y}' AS y, '{x}' AS x, '{z}' AS z, count(*) AS n, var_samp("{x}") AS a11, covar_samp("{x}", "{z}") AS a12, covar_samp("{x}", "{x}" * "{z}") AS a13, var_samp("{z}") AS a22,
        covar_samp("{z}", "{x}" * "{z}") AS a23, var_samp("{x}" * "{z}") AS a33, covar_samp("{x}", "{y}") AS c1, covar_samp("{z}", "{y}") AS c2, covar_samp("{x}" * "{z}", "{y}") AS c3, var_samp("{y}") AS yy FROM scaled"""


def _models() -> str:
    names = [*LINE, _STATUS]
    return " UNION ALL ".join(_moderated(y, x, z) for y in LINE for i, x in enumerate(names) for z in names[i + 1 :] if y not in (x, z))


@query(f"""
    WITH coded AS (SELECT {", ".join(f'CAST({c} AS DOUBLE) AS "{c}"' for c in LINE)}, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS "{_STATUS}" FROM lineitem),
    scaled AS (SELECT {", ".join(f'("{c}" - avg("{c}") OVER ()) / stddev_samp("{c}") OVER () AS "{c}"' for c in [*LINE, _STATUS])} FROM coded),
    m AS ({_models()}),
    d AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det,
        a11 * a22 - a12 * a12 AS det2 FROM m),
    s AS (SELECT *, (c1 * (a22 * a33 - a23 * a23) - a12 * (c2 * a33 - a23 * c3) + a13 * (c2 * a23 - a22 * c3)) / det AS b1,
        (a11 * (c2 * a33 - a23 * c3) - c1 * (a12 * a33 - a23 * a13) + a13 * (a12 * c3 - c2 * a13)) / det AS b2,
        (a11 * (a22 * c3 - c2 * a23) - a12 * (a12 * c3 - c2 * a13) + c1 * (a12 * a23 - a22 * a13)) / det AS b3,
        ((c1 * a22 - c2 * a12) * c1 + (c2 * a11 - c1 * a12) * c2) / det2 / yy AS r2_less FROM d),
    r AS (SELECT *, (b1 * c1 + b2 * c2 + b3 * c3) / yy AS r2 FROM s),
    t AS (SELECT *, b3 / sqrt(yy * (1 - r2) / (n - 4) * det2 / det) AS t FROM r)
    SELECT y, x, z, n, round(b3, 6) AS b, round(r2 - r2_less, 7) AS delta_r2, round(r2, 6) AS r2, round({sql_p_t("t", "(n - 4)")}, 5) AS p FROM t""")
def interaction_scan(spark, sf_dir):
    found = regress.interactions_all(table(spark, sf_dir, "lineitem"), LINE, ["l_linestatus", "l_returnflag"])
    return rounded(found.select("y", "x", "z", "n", "b", "delta_r2", "r2", "p"), 6, delta_r2=7, p=5)


def _digamma(n: str) -> str:
    """For whole numbers from 1: the asymptotic series six places further on."""
    x = f"({n} + 6.0)"
    return f"(ln{x} - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) + 1 / (240 * {x} ** 8) - (1.0 / {n} + 1.0 / ({n} + 1) + 1.0 / ({n} + 2) + 1.0 / ({n} + 3) + 1.0 / ({n} + 4) + 1.0 / ({n} + 5)))"


@query(f"""
    WITH p AS (SELECT c_custkey AS id, c_acctbal / stddev_pop(c_acctbal) OVER () AS x, c_custkey / stddev_pop(c_custkey) OVER () AS y FROM customer),
    d AS (SELECT a.id, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, a.id = b.id AS itself FROM p a, p b),
    r AS (SELECT id, list_sort(list(greatest(dx, dy)) FILTER (NOT itself))[3] * (1 - 1e-12) AS r FROM d GROUP BY id),
    c AS (SELECT d.id, greatest(1, count(*) FILTER (dx < r)) AS nx, greatest(1, count(*) FILTER (dy < r)) AS ny FROM d JOIN r ON d.id = r.id GROUP BY d.id)
    SELECT 'c_acctbal' AS a, 'c_custkey' AS b, count(*) AS n, round(greatest(0, {_digamma("count(*)")} + {_digamma("3")} - avg({_digamma("nx")}) - avg({_digamma("ny")})), 7) AS mi FROM c""")
def neighbour_information(spark, sf_dir):
    """All customers, without the jitter: hardly a balance comes twice."""
    found = neighbours.mutual_information(table(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"], jitter=False)
    return rounded(found.select("a", "b", "n", "mi"), 7)


@query("""
    WITH s AS (SELECT CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS quality, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS toxic, CAST(n_chars AS DOUBLE) AS n_chars, CAST(labels.doc_id % 97 AS DOUBLE) AS noise
        FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
    l AS (SELECT 'quality' AS outcome, 'n_chars' AS marker, quality = 'yes' AS y, n_chars AS v FROM s UNION ALL SELECT 'quality', 'noise', quality = 'yes', noise FROM s
        UNION ALL SELECT 'toxic', 'n_chars', toxic = 'yes', n_chars FROM s UNION ALL SELECT 'toxic', 'noise', toxic = 'yes', noise FROM s),
    r AS (SELECT *, rank() OVER (PARTITION BY outcome, marker ORDER BY v) + (count(*) OVER (PARTITION BY outcome, marker, v) - 1) / 2.0 AS r FROM l),
    a AS (SELECT outcome, marker, count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0, sum(r) FILTER (y) AS r1 FROM r GROUP BY ALL),
    b AS (SELECT *, (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS raw FROM a),
    c AS (SELECT *, greatest(raw, 1 - raw) AS auc, CASE WHEN raw >= 0.5 THEN 1 ELSE -1 END AS sign FROM b),
    e AS (SELECT *, sqrt((auc * (1 - auc) + (n1 - 1) * (auc / (2 - auc) - auc ** 2) + (n0 - 1) * (2 * auc ** 2 / (1 + auc) - auc ** 2)) / (n1 * n0)) AS se FROM c),
    v AS (SELECT l.outcome, l.marker, sign * v AS s, count(*) FILTER (y) AS o, count(*) FILTER (NOT y) AS z FROM l JOIN c ON l.outcome = c.outcome AND l.marker = c.marker GROUP BY ALL),
    t AS (SELECT outcome, marker, s, sum(o) OVER w / sum(o) OVER (PARTITION BY outcome, marker) AS tpr, sum(z) OVER w / sum(z) OVER (PARTITION BY outcome, marker) AS fpr FROM v WINDOW w AS (PARTITION BY outcome, marker ORDER BY s DESC)),
    best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY outcome, marker ORDER BY round(tpr - fpr, 12) DESC, s DESC) = 1)
    SELECT e.outcome, e.marker, 'yes' AS event, n1, n0, round(auc, 8) AS auc, CASE WHEN sign = 1 THEN 'higher' ELSE 'lower' END AS direction, round(greatest(0, auc - 1.96 * se), 8) AS ci_low, round(least(1, auc + 1.96 * se), 8) AS ci_high,
        round(best.s * sign, 8) AS cutoff, round(tpr, 8) AS sensitivity, round(1 - fpr, 8) AS specificity
    FROM e JOIN best ON e.outcome = best.outcome AND e.marker = best.marker""")
def roc_outcomes(spark, sf_dir):
    found = regress.roc_all(_outcomes(spark, sf_dir), ["n_chars", "noise"], ["quality", "toxic"])
    return rounded(found.select("outcome", "marker", "event", "n1", "n0", "auc", "direction", "ci_low", "ci_high", "cutoff", "sensitivity", "specificity"), 8)


def _differences() -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE) AS v FROM lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1 :])


@query(f"""
    WITH d AS ({_differences()}),
    m AS (SELECT a, b, count(*) AS n, avg(v) AS difference, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS median_difference FROM d GROUP BY a, b),
    r AS (SELECT a, b, v, rank() OVER w + (count(*) OVER (PARTITION BY a, b, abs(v)) - 1) / 2.0 AS r FROM d WHERE v <> 0 WINDOW w AS (PARTITION BY a, b ORDER BY abs(v))),
    w AS (SELECT a, b, least(coalesce(sum(r) FILTER (v > 0), 0), coalesce(sum(r) FILTER (v < 0), 0)) AS w FROM r GROUP BY a, b)
    SELECT m.a, m.b, n, round(difference, 6) AS difference, round(sd, 6) AS sd, round(median_difference, 6) AS median_difference, round(difference / (sd / sqrt(n)), 4) AS t,
        round(w, 1) AS w, round(difference / sd, 7) AS d_z, 'wilcoxon' AS recommended
    FROM m JOIN w ON m.a = w.a AND m.b = w.b""")
def paired_tests(spark, sf_dir):
    """No difference of two columns of lines is normal, so signed ranks are recommended for all."""
    found = paired.paired_tests(table(spark, sf_dir, "lineitem"), LINE)
    return rounded(found.select("a", "b", "n", "difference", "sd", "median_difference", "t", "w", "d_z", "recommended"), 6, t=4, w=1, d_z=7)


@query()
def findings_of_all_families(spark, sf_dir):
    """What stays significant of correlations, groups, categories, pairs, outcomes, curves and interactions; each family has queries with SQL of its own."""
    lines, outcomes = table(spark, sf_dir, "lineitem"), _outcomes(spark, sf_dir).withColumn("kilo_chars", F.col("n_chars") / 1000)
    hidden = curves.hidden_formulas(table(spark, sf_dir, "part").withColumn("bent", (F.col("p_size") - 20) ** 2), [*PARTS, "bent"]).where("hidden")
    moderated = regress.interactions_all(lines, LINE, ["l_linestatus"]).withColumn("x_z", F.concat_ws(" × ", "x", "z"))
    found = [
        report.as_findings(correlate.with_p(correlate.pearson_pairs(lines, LINE)), "correlation", "a", "b", "r"),
        report.as_findings(groups.anova_p(groups.anova(groups.group_moments(_line_groups(spark, sf_dir)))), "group", "number", "category", "eta2"),
        report.as_findings(cube.association_pairs(lines, ["l_returnflag", "l_linestatus", "l_linenumber"]), "association", "a", "b", "cramer_v"),
        report.as_findings(paired.paired_tests(lines, LINE), "paired", "a", "b", "d_z"),
        report.as_findings(regress.logistic_all(outcomes, ["kilo_chars", "noise"], ["quality", "toxic"]), "logistic", "outcome", "predictor", "odds_ratio"),
        report.as_findings(hidden, "hidden formula", "y", "x", "adj_r2"),
        report.as_findings(moderated, "interaction", "y", "x_z", "b"),
    ]
    return rounded(report.significant_findings(found), 8)


@query()
def skipped_of_all_families(spark, sf_dir):
    few = table(spark, sf_dir, "region").select("r_regionkey", F.lit(1.0).alias("flat"), F.col("r_regionkey").cast("double").alias("key"), F.when(F.col("r_regionkey") < 2, "low").otherwise("high").alias("half"), F.lit("same").alias("constant"))
    return report.skipped_tests({
        "association": (cube.association_pairs(few, ["half", "constant"]), ["a", "b"]), "paired": (paired.paired_tests(few.where("r_regionkey < 3"), ["flat", "key"]), ["a", "b"]),
        "logistic": (regress.logistic_all(few, ["key"], ["half"]), ["outcome"]), "roc": (regress.roc_all(few, ["key", "flat"], ["half"]), ["outcome", "marker"]),
    })
