"""The curve scan of many pairs at once against numpy, pair by pair, with values missing in places of their own."""

import numpy as np
import pandas as pd

from statloom.operators.curves import fit_curves, hidden_formulas


def test_pairs_fitted_together_equal_single_fits(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(1e6 + 1, 1e6 + 50, 300)
    table = pd.DataFrame({"x": x, "log": 5 + 8 * np.log(x - 1e6) + rng.normal(0, 0.5, 300), "square": (x - 1e6 - 25) ** 2 + rng.normal(0, 5, 300), "flat": 3.0})
    table.loc[::7, "x"], table.loc[3::11, "log"], table.loc[5::13, "square"] = None, np.nan, None
    df = spark.createDataFrame(table).repartition(3)
    fits = {r["model"]: r for r in fit_curves(df, "x", "square").collect()}
    both = table[["x", "square"]].dropna()
    u, y = both["x"] - both["x"].mean(), both["square"]
    assert set(fits) == {"linear", "quadratic", "cubic", "logarithmic", "inverse"}  # y falls below zero
    for model, degree in (("linear", 1), ("quadratic", 2), ("cubic", 3)):
        rest = ((np.polyval(np.polyfit(u, y, degree), u) - y) ** 2).sum()
        assert fits[model]["n"] == len(both)
        assert np.isclose(fits[model]["sse"], rest, rtol=1e-7)
        assert np.isclose(fits[model]["r2"], 1 - rest / ((y - y.mean()) ** 2).sum(), rtol=1e-7)
    pairs = {frozenset((r["x"], r["y"])): r for r in hidden_formulas(df, list(table.columns)).collect()}
    assert set(pairs) == {frozenset(("x", "log")), frozenset(("x", "square")), frozenset(("log", "square"))}  # nothing varies in flat
    assert pairs[frozenset(("x", "square"))]["hidden"] and pairs[frozenset(("x", "log"))]["hidden"]


def test_few_rows_and_empty_tables_have_no_curve(spark):
    df = spark.range(19).selectExpr("cast(id as double) as x", "cast(id * id as double) as y")
    assert hidden_formulas(df, ["x", "y"]).count() == 0
    assert fit_curves(df.where("x < 0"), "x", "y").count() == 0
