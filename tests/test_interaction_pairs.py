"""The interaction scan of many pairs at once against least squares, pair by pair, with values missing in places of their own."""

import numpy as np
import pandas as pd

from statloom.operators.regress import interactions


def test_pairs_fitted_together_equal_single_models(spark):
    rng = np.random.default_rng(8)
    t = pd.DataFrame({"a": rng.uniform(0, 10, 400) + 1e5, "b": rng.uniform(0, 10, 400), "c": rng.normal(0, 3, 400)})
    t["y"] = 10 + 3 * (t["a"] - 1e5) - 0.25 * (t["a"] - 1e5) * t["b"] + rng.normal(0, 2, 400)
    t["copy"], t["flat"] = 2 * t["b"] + 1, 4.0
    t.loc[::9, "a"], t.loc[2::17, "b"], t.loc[5::23, "y"] = None, np.nan, None
    found = {(r["x"], r["z"]): r for r in interactions(spark.createDataFrame(t).repartition(3), "y", ["y", "a", "b", "c", "copy", "flat"]).collect()}
    # a column and its copy have collinear terms, flat has no variation
    assert set(found) == {("a", "b"), ("a", "c"), ("a", "copy"), ("b", "c"), ("c", "copy")}
    for (x, z), r in found.items():
        own = t[["y", x, z]].dropna()
        s = (own - own.mean()) / own.std()
        ones = np.ones(len(s))
        full, less = np.column_stack([ones, s[x], s[z], s[x] * s[z]]), np.column_stack([ones, s[x], s[z]])
        fit = lambda f: np.linalg.lstsq(f, s["y"], rcond=None)[0]  # noqa: B023, E731
        r2 = lambda f: 1 - ((s["y"] - f @ fit(f)) ** 2).sum() / (s["y"] ** 2).sum()  # noqa: B023, E731
        assert r["n"] == len(own)
        assert np.isclose(r["b"], fit(full)[3], rtol=1e-6)
        assert np.isclose(r["r2"], r2(full), rtol=1e-6) and np.isclose(r["delta_r2"], r2(full) - r2(less), rtol=1e-5, atol=1e-10)
    assert found["a", "b"]["p"] < 1e-6 and found["a", "b"]["b"] < 0


def test_few_rows_or_columns_have_no_model(spark):
    df = spark.range(29).selectExpr("cast(id as double) as y", "cast(id % 5 as double) as a", "cast(id % 7 as double) as b")
    assert interactions(df, "y", ["a", "b"]).count() == 0
    assert interactions(df, "y", ["a"]).count() == 0
    assert interactions(df.where("y < 0"), "y", ["a", "b"]).count() == 0
