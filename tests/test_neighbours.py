"""Nearest-neighbour information against brute force."""

import numpy as np
import pandas as pd
import pytest

from statloom.operators import discovery, neighbours

GAMMA = 0.5772156649015329


def psi(n):
    return -GAMMA + np.array([0.0, *np.cumsum(1 / np.arange(1, 5000))])[np.asarray(n) - 1]


def brute(x, y, k=3):
    x, y = x / x.std(), y / y.std()
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, 1)[:, k - 1 : k]
    count = lambda z: np.maximum((z < r * (1 - 1e-12)).sum(1), 1)  # noqa: E731  steps of one size differ in their last bits
    return max(0, psi(len(x)) + psi(k) - psi(count(dx)).mean() - psi(count(dy)).mean())


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    t = pd.DataFrame({"x": x, "bent": x**2 + 0.3 * rng.normal(size=2000), "skew": np.exp(3 * rng.normal(size=2000)), "steps": rng.integers(0, 4, 2000).astype(float)})
    t.loc[::11, "bent"], t.loc[5::7, "skew"] = np.nan, np.nan
    return t


@pytest.mark.parametrize("cell", [40, 5000])
def test_information_equals_brute_force(spark, table, cell):
    """Small cells make most points ask other cells, and ranks cross buckets."""
    columns = ["x", "bent", "skew", "steps"]
    found = {(r["a"], r["b"]): r for r in neighbours.mutual_information(spark.createDataFrame(table).repartition(4), columns, cell=cell, jitter=False).collect()}
    assert len(found) == 6
    for (a, b), r in found.items():
        own = table[[a, b]].dropna()
        assert r["n"] == len(own)
        assert r["mi"] == pytest.approx(brute(own[a].to_numpy(), own[b].to_numpy()), abs=1e-9), (a, b)


def test_jitter_orders_equal_values(spark, table):
    df = spark.createDataFrame(table)
    plain = neighbours.mutual_information(df, ["x", "bent"], jitter=False).first()
    moved = neighbours.mutual_information(df, ["x", "bent"]).first()
    assert moved["mi"] == pytest.approx(plain["mi"], abs=1e-6)
    steps = table[["steps"]].assign(copy=table["steps"] * 2)
    # copies of a few values: with an order inside them, far less than with none
    assert neighbours.mutual_information(spark.createDataFrame(steps), ["steps", "copy"], cell=100).first()["mi"] > 1


def test_a_bent_relation_is_found_and_few_rows_are_left_out(spark, table):
    df = spark.createDataFrame(table)
    finds = discovery.nonlinear_finds(neighbours.mutual_information(df, ["x", "bent", "skew"])).collect()
    assert [(r["a"], r["b"]) for r in finds] == [("x", "bent")] and finds[0]["gap"] > 0.5
    assert neighbours.mutual_information(df.limit(20), ["x", "bent"]).count() == 0
    assert neighbours.mutual_information(df, ["x"]).count() == 0
    assert neighbours.mutual_information(df.withColumn("flat", df["x"] * 0), ["x", "flat"]).count() == 0
