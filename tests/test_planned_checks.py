"""The planner's inputs: normality by group, and the least expected count."""

import random

import pytest

from statloom.operators import contingency
from statloom.plans import queries


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(600):
        g, rare = i % 2, i < 6
        apart = rng.gauss(0, 1) + (1000 if g else 0)
        hidden = rng.gauss(0, 1) if g or i % 12 else rng.gauss(0, 1) + 9
        out.append((round(apart, 6), round(hidden, 6), "ab"[g], "xy"[rare]))
    return out


def test_groups_decide_and_rare_levels_ask_for_fisher(spark, rows):
    df = spark.createDataFrame(rows, "apart double, hidden double, g string, h string")
    plan = {(r["dv"], r["iv"]): r["test"] for r in queries._planned(df, "apart").collect()}
    assert plan["apart", "g"] in ("student_t", "welch_t")  # pooled, the column has two peaks
    assert plan["hidden", "g"] == "mann_whitney"  # one skewed group is enough
    assert plan["apart", "hidden"] == "spearman"  # not both are normal on their common rows
    assert plan["g", "h"] == "fisher"  # six of 600 rows have the level y, so three are expected


def test_least_expected_is_the_minimum(spark, rows):
    df = spark.createDataFrame(rows, "apart double, hidden double, g string, h string")
    r = contingency.least_expected(contingency.crosstab(df, "g", "h")).first()
    assert (r["n"], r["n_rows"], r["n_columns"], r["least_expected"]) == (600, 2, 2, 3.0)


def test_the_registered_plan_has_an_association(spark):
    plan = queries.QUERIES["planned_tests"](spark, "/root/testdata/sf0.001").collect()
    assert ("o_orderstatus", "o_orderpriority") in {(r["dv"], r["iv"]) for r in plan if r["family"] == "association"}
    assert {"group", "correlation"} <= {r["family"] for r in plan}
