"""Concordance from buckets equals the count over all pairs, whatever the cuts."""

import math
import random

import pytest

from statloom.operators.correlate import kendall, kendall_test
from statloom.operators.ranks import concordance


def brute(rows):
    rows = [(a, b) for a, b in rows if a is not None and b is not None and a == a and b == b]
    sign = lambda v: (v > 0) - (v < 0)
    return len(rows), sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :])


def tables():
    r = random.Random(3)
    smooth = [(a := r.gauss(0, 1), a + r.gauss(0, 1)) for _ in range(300)]
    yield "continuous", smooth
    yield "few values", [(float(r.randint(1, 4)), float(r.randint(1, 5))) for _ in range(300)]
    yield "a hot value", [(7.0, r.random()) for _ in range(150)] + [(r.random() * 14, 2.0) for _ in range(80)] + smooth[:80]
    yield "missing", [(None, 1.0), (2.0, None), (math.nan, 1.0), *smooth[:40]]
    yield "falling", [(float(i), float(-i)) for i in range(60)]


@pytest.mark.parametrize(("name", "rows"), list(tables()), ids=lambda v: v if isinstance(v, str) else "")
def test_equals_all_pairs(spark, name, rows):
    df = spark.createDataFrame(rows, "x double, y double")
    for buckets in (2, 64):
        found = concordance(df, "x", "y", buckets).first()
        assert (found["n"], found["s"]) == brute(rows)


def test_test_of_known_values(spark):
    x, y = [12, 2, 1, 12, 2], [1, 4, 7, 1, 0]
    found = kendall_test(spark.createDataFrame(list(zip(x, y, strict=True)), "x int, y int"), "x", "y").first()
    assert found["tau_b"] == pytest.approx(-0.47140452079103173)
    # variance of s by hand: (20 * 15 - 36 - 18) / 18 + 2 * 2 * 1 / 20
    assert found["z"] == pytest.approx(-4 / math.sqrt(246 / 18 + 0.2))
    assert found["p"] == pytest.approx(math.erfc(4 / math.sqrt(246 / 18 + 0.2) / math.sqrt(2)), abs=1e-9)


def test_empty_and_one_value(spark):
    empty = concordance(spark.createDataFrame([], "x double, y double"), "x", "y").first()
    assert empty["n"] is None and empty["s"] == 0
    one = kendall_test(spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double"), "x", "y").first()
    assert (one["n"], one["s"], one["tau_b"], one["z"], one["p"]) == (5, 0.0, None, None, None)
    assert kendall(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "x", "y").first()["tau_b"] is None
