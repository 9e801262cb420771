"""Rows of equal codes are one cell: tables of many blocks grow without jobs a depth, with the trees, scores and importances of single rows."""

import numpy as np
import pandas as pd
import pytest

from statloom.operators import boosting, predict

TARGETS = [boosting.Target("y"), boosting.Target("x"), boosting.Target("group", ["a", "b", "c"]), boosting.Target("sick", ["no", "yes"])]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x, group = rng.integers(0, 6, n).astype(float), rng.choice(["a", "b", "c"], n)
    y = 1e6 + x + 2.0 * (group == "b") + rng.integers(0, 4, n)
    table = pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "group": group, "sick": np.where(rng.random(n) < (1 + x) / 8, "yes", "no")})
    table.loc[::17, "x"], table.loc[::19, "y"], table.loc[::29, "sick"] = np.nan, np.nan, None
    return spark.createDataFrame(table).repartition(3).cache()


@pytest.fixture
def packed(df, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 20)  # 150 blocks
    coding = boosting.learn_coding(df, ["x", "y"], ["group", "sick"])
    return boosting.packed(df, "id", coding, TARGETS, 3), coding


def no_jobs_a_depth(*_):
    raise AssertionError("a job a depth")


def test_many_blocks_of_few_cells_grow_without_jobs_a_depth(packed, monkeypatch):
    blocks, coding = packed
    together_blocks, together = boosting.fit(blocks, coding, TARGETS, 3, 4, few_blocks=0)
    monkeypatch.setattr(boosting, "_level", no_jobs_a_depth)
    monkeypatch.setattr(boosting, "PACKED_ROWS", 50)  # several packs a target
    same, apart = boosting.fit(blocks, coding, TARGETS, 3, 4, margins=False)
    assert same is blocks
    np.testing.assert_allclose(together.gains, apart.gains, rtol=1e-7)
    for one, two in zip(apart.rounds, together.rounds, strict=True):
        split = one[0] >= 0
        assert (one[0] == two[0]).all() and (one[1] == two[1])[split].all()
        np.testing.assert_allclose(one[2], two[2], atol=1e-9)
    # rows near 1e6 are judged by their margins one by one there, by sums around the mean here
    np.testing.assert_allclose(boosting.fold_scores(blocks, apart, 3), boosting.fold_scores(together_blocks, together, 3), atol=1e-4)


def test_more_cells_than_a_task_takes_grow_together(packed, monkeypatch):
    blocks, coding = packed
    rows = blocks.toPandas()
    codes = np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(4, -1) for _, r in rows.iterrows()], 1)
    dealt = np.concatenate([np.frombuffer(r["folds"], np.int8).reshape(4, -1) for _, r in rows.iterrows()], 1)
    names = [t.name for t in TARGETS]
    forest = boosting.Forest(TARGETS, 4, np.zeros(len(boosting.Forest(TARGETS, 4, np.zeros(0)).outputs())))
    found = boosting._cells_of(blocks, coding, forest, 3, 48).toPandas()
    most = 0
    for i, own in found.groupby("target"):
        others = [j for j, c in enumerate(coding.features) if c != names[i]]
        cells, n = np.unique(codes[others][:, dealt[i] >= 0], axis=1, return_counts=True)
        most = max(most, len(n))
        got = {}
        for _, r in own.iterrows():
            k = np.frombuffer(r["codes"], np.uint8).reshape(len(others), -1)
            s = np.frombuffer(r["sums"]).reshape(3, -1, k.shape[1])
            got |= dict(zip(map(bytes, k.T), (s.sum((0, 1)) if TARGETS[i].levels else s[:, 0].sum(0)).tolist(), strict=True))
        assert got == dict(zip(map(bytes, cells.T), n.tolist(), strict=True))
    assert 20 < most < 960
    assert boosting._cells_of(blocks, coding, forest, 3, 1) is None  # a block of 20 rows is less than the cells


def test_guesses_looked_up_equal_trees(packed, monkeypatch):
    blocks, coding = packed
    blocks, forest = boosting.fit(blocks, coding, TARGETS, 3, 4)
    whole = boosting.fold_scores(blocks, forest, 3)[:, -1]
    monkeypatch.setattr(boosting, "GUESSES", 40)
    asked = []
    guesses = boosting._guesses
    monkeypatch.setattr(boosting, "_guesses", lambda *given: asked.append(guesses(*given)) or asked[-1])
    looked = boosting.permutation_importance(blocks, coding, forest, whole, 2)
    assert sorted(asked[0]) == [0, 1, 2, 3]
    monkeypatch.setattr(boosting, "FEW_BYTES", 0)
    walked = boosting.permutation_importance(blocks, coding, forest, whole, 2)
    assert asked[1] == {} and looked.max() > 0.05
    np.testing.assert_allclose(looked, walked, atol=1e-9)


def test_predictability_of_many_blocks(df, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 20)
    monkeypatch.setattr(boosting, "_level", no_jobs_a_depth)
    found = {r["target"]: r for r in predict.predictability(df, "id", ["x", "y"], ["group", "sick"], rounds=6).collect()}
    assert all(r["reason"] is None for r in found.values()) and found["y"]["score"] > 0.3 and found["y"]["top"][0]["variable"] == "x"
