"""Pairs of categories: gates, exact tests and the answers that were wrong before."""

import itertools
import math

import pytest

from statloom.operators import contingency, correlate, cube, paired, records, regress
from statloom.operators.findings import regression_results
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rated(spark):
    rows = [("x", "x"), ("x", "y"), ("y", "y")] * 5 + [("y", "x")] * 3
    rows = [(a, b, "z" if i % 2 else "x", None if i < 12 else b, "one") for i, (a, b) in enumerate(rows)]
    return spark.createDataFrame(rows, "a string, b string, other string, few string, same string").repartition(3)


def test_agreement_asks_for_the_same_levels_and_ten_rows(rated):
    found = {(r["a"], r["b"]): r for r in cube.agreement_pairs(rated, rated.columns).collect()}
    assert set(found) == {("a", "b"), ("a", "few"), ("b", "few")}  # x and z against x and y is no question of agreement
    r = found["a", "b"]
    po, pe = 10 / 18, (10 * 8 + 8 * 10) / 18**2
    assert r["kappa"] == pytest.approx((po - pe) / (1 - pe)) and r["levels"] == "x, y" and r["weighted_kappa"] is None
    assert r["mcnemar"] == 3 and r["mcnemar_p"] == pytest.approx(2 * sum(math.comb(8, k) for k in range(4)) / 2**8)
    assert found["a", "few"]["reason"] == "n=6 < 10" and found["a", "few"]["kappa"] is None
    assert contingency.agreement(rated, "a", "other").count() == 0


def test_association_of_all_pairs(rated):
    found = {(r["a"], r["b"]): r for r in cube.association_pairs(rated, rated.columns).collect()}
    assert set(found) == set(itertools.combinations(rated.columns, 2))
    r = found["a", "b"]
    table = [[5, 5], [3, 5]]
    e = [[10 * 8 / 18, 100 / 18], [64 / 18, 80 / 18]]
    assert r["statistic"] == pytest.approx(sum((abs(table[i][j] - e[i][j]) - min(0.5, abs(table[i][j] - e[i][j]))) ** 2 / e[i][j] for i in (0, 1) for j in (0, 1)))
    assert r["odds_ratio"] == pytest.approx(25 / 15) and r["low_expected"] == 3 and "Fisher" in r["reliable"]
    own = math.comb(10, 5) * math.comb(8, 3)
    assert r["fisher_p"] == pytest.approx(sum(math.comb(10, k) * math.comb(8, 8 - k) for k in range(9) if math.comb(10, k) * math.comb(8, 8 - k) <= own) / math.comb(18, 8))
    alone = contingency.fisher_exact(contingency.crosstab(rated, "a", "b")).first()
    assert alone["p"] == pytest.approx(r["fisher_p"]) and alone["odds_ratio"] == pytest.approx(r["odds_ratio"])
    assert {k for k, v in found.items() if v["reason"]} == {p for p in found if "same" in p}
    assert {r["test"] for r in cube.skipped_pairs(cube.association_pairs(rated, ["a", "same"]), "association").collect()} == {"association: a × same"}


def test_pairs_without_rows(spark):
    df = spark.createDataFrame([("x", None)] * 3 + [(None, "y")] * 3, "a string, b string")
    r = cube.association_pairs(df, ["a", "b"]).first()
    assert r["n"] == 0 and r["reason"].startswith("fewer than") and cube.agreement_pairs(df, ["a", "b"]).count() == 0
    assert cube.association_pairs(df, ["a"]).count() == 0


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (nan, 9.0), (5.0, nan), (6.0, 7.0)], "x double, y double")
    known = df.where("not isnan(x) and not isnan(y)")
    assert correlate.spearman(df, "x", "y").first() == correlate.spearman(known, "x", "y").first()
    assert correlate.simple_regression(df, "x", "y").first() == correlate.simple_regression(known, "x", "y").first()
    assert correlate.pearson_pairs(df, ["x", "y"]).first()["r"] == pytest.approx(correlate.pearson_pairs(known, ["x", "y"]).first()["r"])
    assert paired.wilcoxon(df, "x", "y").first() == paired.wilcoxon(known, "x", "y").first()
    scored = spark.createDataFrame([(i % 2, nan if i == 4 else float(i * i % 11)) for i in range(24)], "y int, s double")
    assert regress.roc_auc(scored, "y", ["s"]).first()["n0"] == 11
    assert regress.youden(scored, "y", "s").first() == regress.youden(scored.where("not isnan(s)"), "y", "s").first()


def test_a_planned_regression_takes_ten_rows_more_than_predictors(spark):
    rows = [(float(i), *[float((i * k) % 13) for k in (3, 5, 7, 11, 2)]) for i in range(25)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double, d double, e double")
    assert regression_results(df, "y", ["a", "b", "c", "d", "e"]).count() == 1
    assert regression_results(df.limit(14), "y", ["a", "b", "c", "d", "e"]).count() == 0
    assert regress.ols_all(df, df.columns, ["y"]).count() == 0


def test_relevance_is_a_share_of_the_query(spark):
    score = lambda title, abstract=None: spark.range(1).select(records.relevance(F.array(*map(F.lit, ("kaygı", "düzeyi", "doyum", "stres"))), F.lit(title), F.lit(0), F.lit(None).cast("int"), F.lit(abstract).cast("string"), 2025)).first()[0]
    assert score("Kaygı düzeyi: doyum") == pytest.approx(1.5)
    assert score("anything", "") == 0 and score("anything", "known") == 0.5


def test_merged_records_keep_the_first_known_pmid_and_abstract(spark):
    rows = [(1, "10.1/A", "t", "", 3, ["F1"], 1.0, None), (2, "10.1/a", "t", "later", 5, ["F2"], 2.0, "77"), (3, "10.1/a", "t", "last", 1, ["F1"], 0.0, "88")]
    r = records.dedup_records(spark.createDataFrame(rows, "seq long, doi string, title string, abstract string, cited_by long, findings array<string>, score double, pmid string")).first()
    assert (r["seq"], r["abstract"], r["pmid"], r["cited_by"], r["findings"]) == (1, "later", "77", 5, ["F1", "F2"])


def test_the_introduction_has_a_pool_of_its_own(spark):
    scored = spark.createDataFrame([(target, f"k{i:02}", float(i % 5)) for target in ("F1", "INTRO") for i in range(20)], "target string, key string, score double")
    found = records.top_per_target(scored, "target", 3).groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in found} == {"F1": 3, "INTRO": 8}
    assert [r["key"] for r in records.top_per_target(scored, "target", 3).where("target = 'F1'").orderBy("rank").collect()] == ["k04", "k09", "k14"]
