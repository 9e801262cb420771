"""Logistic models of all outcomes and interactions of all numbers in shared passes, against one model at a time."""

import numpy as np
import pandas as pd
import pytest

from statloom.operators import regress


def newton(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (p * (1 - p))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (y - p))
    like = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    m = y.mean()
    return b, np.sqrt(np.diag(np.linalg.inv(h))), 1 - like / (len(y) * (m * np.log(m) + (1 - m) * np.log(1 - m))), x @ b


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    n = 600
    t = pd.DataFrame({"a": rng.normal(50, 9, n), "b": rng.uniform(0, 1, n) * 1e4})
    draw = lambda at: rng.random(n) < 1 / (1 + np.exp(-at))
    t["sick"] = np.where(draw((t["a"] - 50) / 5), "yes", "no")
    t["paid"] = np.where(draw(t["b"] / 4000 - 2), 1, 0)
    t["apart"] = np.where(t["a"] > 50, "high", "low")
    t["rare"] = np.where(np.arange(n) < 3, "some", "none")
    t["three"] = rng.choice(["x", "y", "z"], n)
    t["one"] = "same"
    t.loc[::13, "a"], t.loc[4::17, "sick"] = np.nan, None
    return t


def test_all_outcomes_equal_single_models(spark, table):
    found = regress.logistic_all(spark.createDataFrame(table).repartition(3), ["a", "b"], ["sick", "paid", "apart", "rare", "three", "one"]).collect()
    by = {(r["outcome"], r["predictor"]): r for r in found}
    assert set(by) == {("sick", "a"), ("sick", "b"), ("paid", "a"), ("paid", "b"), ("apart", None), ("rare", None)}
    assert by["apart", None]["reason"] == "separated or not converged" and "are needed" in by["rare", None]["reason"]
    for outcome, event in (("sick", "yes"), ("paid", 1)):
        own = table.dropna(subset=["a", "b", outcome])
        y = (own[outcome] == event).to_numpy(float)
        b, se, r2, score = newton(own[["a", "b"]].to_numpy(), y)
        auc = (score[y == 1][:, None] > score[y == 0]).mean() + (score[y == 1][:, None] == score[y == 0]).mean() / 2
        for j, name in enumerate(("a", "b"), 1):
            r = by[outcome, name]
            assert (r["n"], r["n_events"], r["event"]) == (len(own), int(y.sum()), str(event))
            np.testing.assert_allclose([r["b"], r["se"], r["mcfadden_r2"], r["auc"]], [b[j], se[j], r2, auc], rtol=1e-6)
            np.testing.assert_allclose([r["odds_ratio"], r["ci_low"]], np.exp([b[j], b[j] - 1.959963984540054 * se[j]]), rtol=1e-6)
    ps = sorted(r["p"] for r in found if r["p"] is not None)
    assert min(r["p_bh"] for r in found if r["p"] is not None) == pytest.approx(min(p * 4 / i for i, p in enumerate(ps, 1)))


def test_no_outcome_or_no_number(spark, table):
    df = spark.createDataFrame(table)
    assert regress.logistic_all(df, ["a"], ["three", "one"]).count() == 0
    assert regress.logistic_all(df, [], ["sick"]).count() == 0
    assert regress.logistic_all(df.limit(0), ["a"], ["sick"]).count() == 0


def test_every_number_is_a_dependent_of_every_pair(spark, table, monkeypatch):
    monkeypatch.setattr(regress, "MODELS_AT_ONCE", 7)  # several passes
    t = table[["a", "b", "paid", "sick", "three"]].assign(c=table["a"] * table["b"] / 1e4)
    found = {(r["y"], r["x"], r["z"]): r for r in regress.interactions_all(spark.createDataFrame(t).repartition(3), ["a", "b", "c"], ["sick", "three"]).collect()}
    event = "sick (yes=1)"
    assert set(found) == {("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"), *[(y, x, event) for y in "abc" for x in "abc" if x != y]}
    t[event] = np.where(t["sick"].isna(), np.nan, t["sick"].eq("yes"))
    for (y, x, z), r in found.items():
        own = t[[y, x, z]].dropna()
        s = (own - own.mean()) / own.std()
        f = np.column_stack([np.ones(len(s)), s[x], s[z], s[x] * s[z]])
        fit = np.linalg.lstsq(f, s[y], rcond=None)[0]
        r2 = 1 - ((s[y] - f @ fit) ** 2).sum() / (s[y] ** 2).sum()
        assert r["n"] == len(own)
        np.testing.assert_allclose([r["b"], r["r2"]], [fit[3], r2], rtol=1e-6, atol=1e-9)
    assert found["c", "a", "b"]["p"] < 1e-6
