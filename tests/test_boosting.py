"""Histogram boosting against brute force on small tables, and on planted truth."""

import numpy as np
import pandas as pd
import pytest

from statloom.operators import boosting, predict


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n = 900
    x, z, u = rng.normal(size=(3, n))
    group = rng.choice(["a", "b", "c"], n)
    y = x**2 + 2.0 * (group == "b") + 0.3 * rng.normal(size=n)
    sick = np.where(rng.random(n) < 1 / (1 + np.exp(1 - 3 * z)), "yes", "no")
    table = pd.DataFrame({"id": np.arange(n), "x": x, "z": z, "u": u, "y": y, "group": group, "sick": sick, "alone": ["only"] * n, "many": [f"v{i}" for i in range(n)]})
    table.loc[::17, "x"] = np.nan
    table.loc[::29, "sick"] = None
    return table


@pytest.fixture(scope="module")
def df(spark, planted):
    return spark.createDataFrame(planted).repartition(3)


def test_one_tree_equals_exhaustive_search(spark, monkeypatch):
    """The first split of one round: the cut of all features and bins with the least squared error, checked on several blocks."""
    monkeypatch.setattr(boosting, "BLOCK", 100)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 350), rng.integers(0, 7, 350)
    y = (a > 4) * 3.0 + (b > 2) * 1.0 + rng.normal(size=350)
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(350), "a": a, "b": b, "y": y})).repartition(4)
    coding = boosting.learn_coding(frame, ["a", "b"], [])
    blocks = boosting.packed(frame, "id", coding, [boosting.Target("y")], 5)
    assert sorted(r["n"] for r in blocks.select("n").collect()) == [50, 100, 100, 100]
    _, forest = boosting.fit(blocks, coding, [boosting.Target("y")], 5, 1, depth=1)
    best = max((y[m].sum() ** 2 / m.sum() + y[~m].sum() ** 2 / (~m).sum(), name, cut) for name, v in (("a", a), ("b", b)) for cut in range(int(v.max())) for m in [v <= cut] if 20 <= m.sum() <= 330)
    feature, cut, value = forest.rounds[0]
    assert coding.features[feature[-1, 0]] == best[1]
    mask = (a if best[1] == "a" else b) <= best[2]
    np.testing.assert_allclose(value[-1], [0.1 * (y[mask].mean() - y.mean()), 0.1 * (y[~mask].mean() - y.mean())], rtol=1e-9)
    assert forest.base[-1] == pytest.approx(y.mean())


def test_jobs_a_depth_grow_the_trees_of_small_tables(df, monkeypatch):
    """Both ways to grow give the same trees; margins are rewritten on the way, and tasks send sums directly or by a shuffle."""
    monkeypatch.setattr(boosting, "BLOCK", 200)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    coding = boosting.learn_coding(df, ["x", "z", "u", "y"], ["group", "sick"])
    targets = [boosting.Target("y"), boosting.Target("group", ["a", "b", "c"]), boosting.Target("sick", ["no", "yes"])]
    blocks = boosting.packed(df, "id", coding, targets, 3)
    _, apart = boosting.fit(blocks, coding, targets, 3, 5)
    for direct in (64 << 20, 0):
        monkeypatch.setattr(boosting, "DIRECT_BYTES", direct)
        out, together = boosting.fit(blocks, coding, targets, 3, 5, few_blocks=0)
        np.testing.assert_allclose(together.gains, apart.gains, rtol=1e-7)
        for one, two in zip(apart.rounds, together.rounds, strict=True):
            assert (one[0] == two[0]).all()
            np.testing.assert_allclose(one[2], two[2], atol=1e-9)
    assert boosting.fold_scores(out, together, 3).shape == (3, 4)


def test_folds_are_dealt_within_each_class(df, planted, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 128)
    scores, models = predict.risk(df, "id", ["sick"], ["z", "u"], ["group"], rounds=2, repeats=1)
    rows = scores.toPandas()
    assert len(rows) == planted["sick"].notna().sum() and rows["id"].is_unique
    counts = rows.groupby(["actual", "fold"]).size().unstack()
    assert counts.shape == (2, 5) and (counts.max(axis=1) - counts.min(axis=1)).max() <= 1
    risky = models.first()["risky"]
    assert (planted.set_index("id")["sick"].loc[rows["id"]].eq(risky).astype(int).to_numpy() == rows["actual"]).all()


def test_risk_models_find_the_planted_cause(df):
    scores, models = predict.risk(df, "id", ["sick", "alone", "group"], ["x", "z", "u"], ["group"])
    found = models.collect()
    assert [r["outcome"] for r in found] == ["sick"] and found[0]["auc"] > 0.8 and found[0]["strength"] in ("good", "excellent")
    assert found[0]["top"][0]["variable"] == "z" and found[0]["by_gain"][0] == "z"
    top = predict.riskiest(scores, models, "id").collect()
    assert len(top) == 10 and [r["rank"] for r in top] == list(range(1, 11)) and min(r["risk"] for r in top) > 0.7


def test_every_column_is_a_target(df):
    found = {r["target"]: r for r in predict.predictability(df, "id", ["x", "z", "u", "y"], ["group", "sick", "alone", "many"], rounds=30).collect()}
    assert set(found) == {"x", "z", "u", "y", "group", "sick", "alone", "many"}
    y = found["y"]
    assert y["predictable"] and y["kind"] == "regression" and {t["variable"] for t in y["top"][:2]} == {"x", "group"} and y["score"] > 0.7
    assert found["group"]["kind"] == "classification" and found["group"]["gain"] > 0.1 and found["group"]["top"][0]["variable"] == "y"
    assert found["sick"]["score"] > found["sick"]["baseline"] and not found["u"]["predictable"]
    assert found["alone"]["reason"] == "one level" and found["many"]["reason"] == "no values, or too many levels"


def test_permutations_are_bijections():
    for n in (1, 2, 7, 64, 1000, 12345):
        moved = [boosting.permuted_numbers(np.arange(n), n, k) for k in range(2)]
        assert all(sorted(m.tolist()) == list(range(n)) for m in moved)
    assert (moved[0] != moved[1]).mean() > 0.99
    # neighbours don't stay together: a true permutation, not one inside blocks
    assert np.abs(moved[0] - np.arange(12345)).mean() > 12345 / 4


def test_importance_equals_a_plain_permutation(spark, df, planted, monkeypatch):
    """One repeat, recomputed from the forest in memory; blocks of 100 rows exchange their rows."""
    monkeypatch.setattr(boosting, "BLOCK", 100)
    coding = boosting.learn_coding(df, ["x", "z", "u"], ["group"])
    targets = [boosting.Target("y")]
    coding_y = boosting.learn_coding(df, ["x", "z", "u", "y"], ["group"])
    blocks, forest = boosting.fit(boosting.packed(df, "id", coding_y, targets, 5), coding_y, targets, 5, 12)
    whole = boosting.fold_scores(blocks, forest, 5)[:, -1]
    got = boosting.permutation_importance(blocks, coding_y, forest, whole, repeats=1)[0]
    f = len(coding_y.features)
    rows = blocks.orderBy("block").collect()
    codes = np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(f, -1) for r in rows], 1)
    y = np.concatenate([np.frombuffer(r["values"]) for r in rows])
    to = boosting.permuted_numbers(np.arange(len(y)), len(y), 0)
    last = len(forest.base) - 1

    def r2(c):
        margin = np.full(len(y), forest.base[last])
        for feature, cut, value in forest.rounds:
            margin = margin + value[last][boosting.leaves(c, feature[last], cut[last], boosting.DEPTH)]
        return 1 - ((y - margin) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    want = []
    for j in range(f):
        moved = codes.copy()
        moved[j, to] = codes[j]
        want.append(r2(codes) - r2(moved))
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert got[coding_y.features.index("y")] == 0 and coding.features == ["x", "z", "u", "group"]


def test_small_and_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, a double, b double, c string")
    assert {r["reason"] for r in predict.predictability(empty, "id", ["a", "b"], ["c"]).collect()} == {"no values, or too many levels"}
    scores, models = predict.risk(empty, "id", ["c"], ["a", "b"])
    assert scores.count() == 0 and models.count() == 0
    few = spark.createDataFrame([(i, float(i), float(-i), "x") for i in range(9)], "id long, a double, b double, c string")
    assert all(r["reason"] for r in predict.predictability(few, "id", ["a", "b"], ["c"]).collect())
