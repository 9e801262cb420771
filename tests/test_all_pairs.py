"""Paired tests of all pairs, ROC of all outcomes, and what every family leaves out."""

import numpy as np
import pandas as pd
import pytest

from statloom.operators import curves, describe, groups, paired, regress, report


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(9)
    before = rng.normal(50, 10, 300)
    t = pd.DataFrame({"before": before, "after": before + 5 + rng.normal(0, 4, 300), "skew": before + np.exp(rng.normal(0, 1.5, 300)), "shifted": before + 3.0})
    t["few"] = np.where(np.arange(300) < 4, 1.0, np.nan)
    t["marker"] = rng.integers(0, 9, 300).astype(float)
    t["sick"] = np.where(rng.random(300) < 1 / (1 + np.exp(t["marker"] - 4)), "yes", "no")
    t["rare"] = np.where(np.arange(300) < 3, "some", "none")
    t.loc[::19, "after"], t.loc[::23, "marker"] = np.nan, np.nan
    return t


def test_paired_tests_of_all_pairs(spark, table):
    df = spark.createDataFrame(table).repartition(3)
    columns = ["before", "after", "skew", "shifted", "few"]
    found = {(r["a"], r["b"]): r for r in paired.paired_tests(df, columns).collect()}
    assert len(found) == 10
    r = found["before", "after"]
    d = (table["before"] - table["after"]).dropna()
    assert (r["n"], r["recommended"], r["normal"]) == (len(d), "paired_t", True)
    np.testing.assert_allclose([r["difference"], r["sd"], r["median_difference"], r["d_z"], r["t"]], [d.mean(), d.std(), d.median(), d.mean() / d.std(), d.mean() / d.std() * len(d) ** 0.5])
    assert r["p"] == r["t_p"] < 1e-9 and found["before", "skew"]["recommended"] == "wilcoxon"
    one = paired.wilcoxon_p(paired.wilcoxon(df, "before", "skew")).first()
    assert (found["before", "skew"]["w"], found["before", "skew"]["p"]) == (one["w"], pytest.approx(one["p"]))
    assert found["before", "shifted"]["reason"] == "all differences are the same" or abs(found["before", "shifted"]["sd"]) < 1e-12
    assert found["before", "few"]["reason"] == "n=4 < 5" and found["before", "few"]["p"] is None
    assert paired.paired_tests(df, ["before"]).count() == 0


def test_roc_of_all_outcomes(spark, table):
    df = spark.createDataFrame(table).repartition(3).withColumn("flat", groups.F.lit(1.0))
    found = {(r["outcome"], r["marker"]): r for r in regress.roc_all(df, ["marker", "before", "flat"], ["sick", "rare"]).collect()}
    assert len(found) == 6
    own = table.dropna(subset=["marker"])
    x, y = own["marker"].to_numpy(), (own["sick"] == "yes").to_numpy()
    raw = (x[y][:, None] > x[~y]).mean() + (x[y][:, None] == x[~y]).mean() / 2
    r = found["sick", "marker"]
    assert r["event"] == "yes" and r["direction"] == "lower" and r["auc"] == pytest.approx(1 - raw)
    best = max((round((x[y] <= c).mean() - (x[~y] <= c).mean(), 12), -c) for c in np.unique(x))
    assert r["cutoff"] == -best[1] and r["sensitivity"] == pytest.approx((x[y] <= -best[1]).mean()) and r["specificity"] == pytest.approx((x[~y] > -best[1]).mean())
    assert r["p"] < 1e-6 and r["p_bh"] >= r["p"]
    single = regress.roc_auc(df.withColumn("y", (df["sick"] == "yes").cast("int")), "y", ["before"]).first()
    assert found["sick", "before"]["auc"] == pytest.approx(single["auc"]) and found["sick", "before"]["ci_low"] == pytest.approx(single["ci_low"])
    assert found["sick", "flat"]["reason"] == "constant marker" and found["rare", "before"]["reason"] == "class sizes 3 and 297"
    aucs = [r["auc"] for r in regress.roc_all(df, ["marker", "before"], ["sick"]).collect()]
    assert aucs == sorted(aucs, reverse=True)


def test_skipped_tests_of_several_families(spark, table):
    df = spark.createDataFrame(table)
    found = report.skipped_tests({"paired": (paired.paired_tests(df, ["before", "few"]), ["a", "b"]), "logistic": (regress.logistic_all(df, ["before"], ["rare"]), ["outcome"])}).collect()
    assert [(r["family"], r["test"]) for r in found] == [("logistic", "rare"), ("paired", "before × few")]


def test_hidden_formulas_are_corrected(spark, table):
    found = curves.hidden_formulas(spark.createDataFrame(table), ["before", "after", "skew"]).collect()
    assert all(r["p_bh"] >= r["p"] for r in found) and len(found) == 3


def test_profiles_take_one_aggregate(spark):
    df = spark.range(40).selectExpr("id as serial", "cast(id * 37 % 41 as double) as mixed", "cast(id % 3 as string) as level", "cast(null as string) as nothing", "'one' as same", "concat('text ', id) as words")
    found = {r["variable"]: (r["kind"], r["reason"]) for r in describe.detect_variables(df).collect()}
    assert found == {"serial": ("skipped", "id"), "mixed": found["mixed"], "level": ("categorical", None), "nothing": ("skipped", "all missing"), "same": ("skipped", "constant"), "words": ("skipped", "free text or id")}
