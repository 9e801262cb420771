"""Hard negatives against brute force on integers, and intervals against true inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, anchor string"


def brute(rows):
    """Rows (vec_id, vector, label); every anchor and positive, a copy of a row being another row."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in good]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (anchor, v, label) in enumerate(good):
        if anchor % 100:
            continue
        scored = [(-dot(v, w), i, lab) for m, (i, w, lab) in enumerate(good) if m != n]
        for p, pid in sorted((s, i) for s, i, lab in scored if lab == label)[:5]:
            fit = sorted((s, i) for s, i, lab in scored if lab != label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(anchor, pid, r, i, -p, -s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 20))
    x = centres[rng.integers(0, 6, 900)] + 0.7 * rng.standard_normal((900, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[700:760] = x[3]  # a group of copies, with ties
    x[100] *= 1e-4
    rows = [(i, v.tolist(), int(rng.integers(0, 3)) if i % 5 else 1) for i, v in enumerate(x.astype(np.float32))]
    rows[200] = (200, [-y for y in rows[200][1]], 9)  # alone with its label
    rows += [(1000, rows[3][1], None), (1100, None, 1), (1101, [None] * 20, 1), (1200, [float("nan")] * 20, 1), (1201, [float("inf")] + [0.0] * 19, 1), (None, rows[3][1], 1)]
    rows += [(1300, rows[3][1][:7], 1), (1400, [], 2), rows[300], rows[301]]
    return rows


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA).repartition(3)


LABEL = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"


def mined(vectors, **more):
    return sorted(map(tuple, hardneg.mine(vectors, F.col("vec_id") % 100 == 0, F.expr(LABEL), **more).collect()))


def test_mining_equals_brute_force(vectors, rows):
    expected = brute(rows)
    assert len(expected) > 100
    assert mined(vectors) == expected


@pytest.mark.parametrize("levels", [1, 4])
def test_levels_change_no_result(vectors, rows, levels):
    assert mined(vectors, levels=levels) == brute(rows)


def test_blocks_of_anchors_change_no_result(vectors, rows):
    assert mined(vectors, block_bytes=4000) == brute(rows)


def test_no_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [0.5], 1, "", 1, "")], SCHEMA)) == []


@pytest.mark.parametrize("size", [3, 64, 200])
def test_intervals_hold_and_are_narrow(size):
    rng = np.random.default_rng(size)
    x = rng.integers(-200, 200, (300, size))
    x[0] = 0
    turns = hardneg.rotations(-(-size // 64) * 64)
    codes, parts = hardneg.encode(x, turns)
    anchors = hardneg.Anchors(x[:40], turns)
    middle, half = hardneg.interval(codes, parts, anchors, np.arange(40))
    true = x @ x[:40].T
    assert (np.abs(true - middle) <= half).all()
    lengths = np.linalg.norm(x, axis=1)
    assert (half <= 0.4 * np.maximum(lengths[:, None] * lengths[:40], 1)).mean() > 0.99


def test_filter_spares_most_pairs():
    """Random directions are far from any window near an anchor: hardly a pair is scored."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64))
    x = (256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(int)
    turns = hardneg.rotations(64)
    codes, parts = hardneg.encode(x, turns)
    anchors = hardneg.Anchors(x[:20], turns)
    middle, half = hardneg.interval(codes, parts, anchors, np.arange(20))
    assert ((middle + half) >= 0.7 * 256**2).mean() < 0.02
