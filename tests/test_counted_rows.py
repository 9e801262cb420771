"""Tests on counted rows equal plain ones, and no join by group brings all rows of a group into one task."""

import numpy as np
import pytest

from statloom.operators import correlate, describe, groups, normality, paired


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, 6000) / 4
    y = x + rng.normal(0, 1, 6000).round(1)
    rows = [(float(a), float(b), "pq"[i % 2]) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, *rows[:500], (None, 1.0, "p"), (float("nan"), 2.0, "q")], "x double, y double, g string")



def test_paired_tests_of_counted_rows(rows):
    got = paired.paired_tests(rows, ["x", "y"]).first()
    d = np.array([r["x"] - r["y"] for r in rows.collect() if r["x"] is not None and r["x"] == r["x"]])
    assert got["n"] == len(d) == 6500
    assert got["difference"] == pytest.approx(d.mean()) and got["sd"] == pytest.approx(d.std(ddof=1)) and got["median_difference"] == pytest.approx(np.median(d))
    one = rows.where("x is not null and not isnan(x)").selectExpr("'d' as v", "x - y as value")
    p = normality.normality_of(one, ["v"]).first()["p"]
    assert got["normal"] == (p >= 0.05)
    w = paired.wilcoxon_p(paired.wilcoxon(rows, "x", "y")).first()
    assert got["w"] == pytest.approx(w["w"]) and got["w_p"] == pytest.approx(w["p"])


def test_spearman_of_counted_rows(rows):
    got, one = correlate.spearman_pairs(rows, ["x", "y"]).first(), correlate.spearman(rows, "x", "y").first()
    assert (got["a"], got["b"], got["n"]) == ("x", "y", one["n"]) and got["rho"] == pytest.approx(one["rho"])


def test_rows_are_counted_before_they_are_copied(rows, monkeypatch):
    plans = []
    for module in (paired, correlate):
        real = module.work_table
        monkeypatch.setattr(module, "work_table", lambda df, name, real=real: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    paired.paired_tests(rows, ["x", "y"])
    correlate.spearman_pairs(rows, ["x", "y"])
    assert len(plans) == 2
    for plan in plans:
        assert plan.rindex("Aggregate") > plan.index("Generate")  # an aggregate below the copies


def test_distances_from_medians_and_small_groups_meet_no_group_by_key(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = groups.pairs_long(rows, ["g"], ["x", "y"])
        text = groups.levene(long)._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=broadcast)" in text.split("abs(")[1].split("Aggregate")[0]
        few = normality.shapiro_wilk(describe.long_form(rows, ["x", "y"]), ["variable"])._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in few and "SortMergeJoin" not in few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
