"""Planted effects, closed forms and identities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import special
from statloom.operators import adjust, cleaning, contingency, correlate, curves, describe, groups, paired, records, regress, scale
from statloom.operators.ranks import mid_ranks
from statloom.sources import tables


def frame(spark, **columns):
    names = list(columns)
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else (v.item() if hasattr(v, "item") else v) for v in r) for r in zip(*columns.values(), strict=True)]
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def survey(spark):
    rng = np.random.default_rng(42)
    n = 120
    sex = rng.integers(1, 3, n)
    worry = rng.normal(50, 10, n) + 6 * (sex == 1)
    joy = 100 - 0.6 * worry + rng.normal(0, 8, n)
    return frame(spark, id=np.arange(1.0, n + 1), sex=sex.astype(float), worry=worry, joy=joy, likert=rng.integers(1, 6, n).astype(float), constant=np.ones(n))


def test_special_functions_match_known_values():
    assert special.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.norm_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert float(special.t_quantile(0.05, 10)) == pytest.approx(2.228138852, abs=1e-6)


def test_typing_finds_ids_constants_and_kinds(survey):
    kinds = {r["variable"]: (r["kind"], r["reason"]) for r in describe.detect_variables(survey).collect()}
    assert kinds["id"] == ("skipped", "id") and kinds["constant"] == ("skipped", "constant")
    assert kinds["worry"] == ("numeric", None) and kinds["likert"] == ("categorical", None)


def test_planted_correlation_and_group_difference(survey):
    pairs = {(r["a"], r["b"]): r for r in correlate.with_p(correlate.pearson_pairs(survey, ["worry", "joy", "likert"])).collect()}
    assert pairs["worry", "joy"]["r"] < -0.3 and pairs["worry", "joy"]["p"] < 0.001
    long = groups.pairs_long(survey, ["sex"], ["worry"])
    t = groups.two_groups_p(groups.two_groups(groups.group_moments(long))).first()
    f = groups.anova_p(groups.anova(groups.group_moments(long))).first()
    assert t["p"] < 0.05 and t["t"] > 0 and t["t"] ** 2 == pytest.approx(f["f"]) and t["p"] == pytest.approx(f["p"], rel=1e-6)


def test_constant_column_gives_no_pair(survey):
    assert correlate.pearson_pairs(survey, ["worry", "constant"]).count() == 0


def test_mid_ranks_do_not_depend_on_partitions_or_buckets(spark):
    values = [3.0, 1.0, 1.0, 2.0, 3.0, 3.0, None, 7.0]
    df = frame(spark, v=[float("nan") if v is None else v for v in values])
    for parts, buckets in ((1, 2), (5, 64)):
        got = {r["v"]: r["rank"] for r in mid_ranks(df.repartition(parts), [], "v", buckets).collect()}
        assert got == {1.0: 1.5, 2.0: 3.0, 3.0: 5.0, 7.0: 7.0}


def test_rank_tests_agree_with_each_other(survey):
    sums = groups.rank_sums(groups.pairs_long(survey, ["sex"], ["joy"]))
    h, u = groups.kruskal(sums).first(), groups.mann_whitney(sums).first()
    assert abs(u["z"]) < math.sqrt(h["h"]) < abs(u["z"]) + 0.05  # the continuity correction


def test_holm_and_bh_are_monotone_and_leave_nulls(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,), (0.5,)], "p double")
    rows = adjust.adjust_p(df).orderBy("p").collect()
    known = [r for r in rows if r["p"] is not None]
    assert all(r["p"] <= r["p_bh"] <= r["p_holm"] <= r["p_bonferroni"] for r in known)
    assert [r["p_holm"] for r in rows if r["p"] is None] == [None] and known[0]["p_bonferroni"] == pytest.approx(0.04)


def test_cronbach_alpha_matches_its_closed_form(spark):
    rng = np.random.default_rng(3)
    common = rng.normal(size=20_000)
    items = {f"item{i}": common + rng.normal(size=20_000) for i in range(1, 5)}
    row = scale.reliability(spark.createDataFrame(__import__("pandas").DataFrame(items)), scale.item_groups(list(items))).first()
    assert row["alpha"] == pytest.approx(4 * 0.5 / 2.5, abs=0.02) and row["ci_low"] < row["alpha"] < row["ci_high"] and row["omega"] > 0.75


def test_hidden_log_formula_found_and_line_left_alone(spark):
    rng = np.random.default_rng(11)
    dose, age = rng.uniform(1, 50, 250), rng.uniform(20, 70, 250)
    df = frame(spark, dose=dose, effect=5 + 8 * np.log(dose) + rng.normal(0, 2, 250), age=age, plain=2 * age + rng.normal(0, 5, 250))
    found = {frozenset((r["x"], r["y"])): r["hidden"] for r in curves.hidden_formulas(df, ["dose", "effect", "age", "plain"]).collect()}
    assert found[frozenset(("dose", "effect"))] and not found[frozenset(("age", "plain"))]


def test_regression_roc_and_logistic_find_the_effect(spark):
    rng = np.random.default_rng(7)
    x, z = rng.normal(size=400), rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-1.5 * x))).astype(int)
    df = frame(spark, y=y, x=x, z=z, w=2 * x + z + rng.normal(0, 0.1, 400))
    auc = regress.roc_auc(df, "y", ["x"]).first()
    assert auc["auc"] > 0.75 and auc["direction"] == "higher"
    odds = {r["predictor"]: r["odds_ratio"] for r in regress.logistic(df, "y", ["x", "z"]).collect()}
    assert odds["x"] > 2.5
    b = {r["predictor"]: r["b"] for r in regress.ols_all(df, ["w", "x", "z"], ["w"]).collect()}
    assert b["x"] == pytest.approx(2, abs=0.05) and b["z"] == pytest.approx(1, abs=0.05)


def test_contingency_measures(spark):
    rows = [("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 1 + [("b", "y")] * 5
    t = contingency.crosstab(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    fisher = contingency.fisher_exact(t).first()
    assert fisher["p"] == pytest.approx(0.0349650, abs=1e-6) and fisher["odds_ratio"] == 20.0
    assert contingency.mcnemar(t).first()["exact_p"] == 1.0


def test_wilcoxon_and_friedman_by_hand(spark):
    df = frame(spark, a=[float(v) for v in range(1, 11)], b=[2.0, 1.0, 5.0, 7.0, 9.0, 3.0, 9.0, 12.0, 14.0, 16.0], c=[3.0] * 10)
    w = paired.wilcoxon(df, "a", "b").first()
    assert w["n"] == 10 and w["w_plus"] + w["w_minus"] == 55
    assert paired.friedman(df, ["a", "b", "c"]).first()["n"] == 10


def test_cleaning_steps(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (3, 2.0), (4, 3.0), (5, 4.0), (6, 1000.0)], "k int, v double")
    assert cleaning.drop_repeats(df).count() == 6
    assert cleaning.null_outliers(df, ["v"]).where("v is null").count() == 2


def test_markers_are_renumbered_in_order_of_appearance(spark):
    texts = spark.createDataFrame([(1, "b [7, 3] and [3]"), (2, "then [9] and [7]")], "section int, text string")
    numbers = records.first_appearance(records.markers(texts, "section", "text"), ["section", "pos"])
    got = {r["section"]: r["text"] for r in records.renumber(texts, "section", "text", numbers).collect()}
    assert got == {1: "b [1, 2] and [2]", 2: "then [3] and [1]"}


def test_csv_of_another_separator_and_encoding(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("ad;yaş\nAyşe;3\n".encode("windows-1254"))
    assert tables.load_csv(spark, str(path)).columns == ["ad", "yaş"]


def test_tiny_tables_do_not_fail(spark):
    for n in (0, 1, 2, 3):
        df = spark.range(n).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.lit("g").alias("g"))
        correlate.pearson_pairs(df, ["a", "b"]).collect()
        groups.anova(groups.group_moments(groups.pairs_long(df, ["g"], ["a"]))).collect()
        paired.paired_t(df, ["a", "b"]).collect()
        curves.fit_curves(df, "a", "b").collect()
        describe.describe_numeric(df, ["a", "b"]).collect()
