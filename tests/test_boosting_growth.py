"""Splits are searched where the histograms are, whatever the groups of outputs; the driver doesn't receive histograms."""

import numpy as np
from pyspark.sql import functions as F

from statloom.operators import boosting


def test_leaves_equal_a_walk_down_the_tree():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, boosting.BINS, (3, 500)).astype(np.uint8)
    feature, cut = np.array([1, 0, -1, 2, 1, 0, 2]), np.array([20, 10, 0, 30, 5, 25, 40])
    for depth in range(4):
        walked = []
        for r in range(500):
            node = 0
            for d in range(depth):
                at = node + (1 << d) - 1
                node = 2 * node + int(feature[at] >= 0 and codes[feature[at], r] > cut[at])
            walked.append(node)
        assert boosting.leaves(codes, feature, cut, depth).tolist() == walked


def test_groups_of_outputs_grow_the_same_trees(spark, monkeypatch):
    df = spark.range(900).select("id", (F.xxhash64("id") % 100 / 100).alias("x"), (F.xxhash64("id", F.lit(1)) % 100 / 100).alias("z"), F.concat(F.lit("g"), F.col("id") % 3).alias("g"))
    df = df.withColumn("y", F.col("x") * 3 + F.when(F.col("g") == "g1", 1.0).otherwise(0.0)).cache()
    monkeypatch.setattr(boosting, "BLOCK", 200)
    coding = boosting.learn_coding(df, ["x", "z", "y"], ["g"])
    targets = [boosting.Target("y"), boosting.Target("g", ["g0", "g1", "g2"])]
    blocks = boosting.packed(df, "id", coding, targets, 3)
    _, apart = boosting.fit(blocks, coding, targets, 3, 2)
    monkeypatch.setattr(boosting, "DIRECT_BYTES", 1)  # a group for each output
    received = []
    level = boosting._level

    def measured(*given):
        found = level(*given)
        received.append(sum(x.nbytes for x in found))
        return found

    monkeypatch.setattr(boosting, "_level", measured)
    _, together = boosting.fit(blocks, coding, targets, 3, 2, few_blocks=0)
    for a, b in zip(apart.rounds, together.rounds, strict=True):
        split = a[0] >= 0
        assert (a[0] == b[0]).all() and (a[1] == b[1])[split].all() and np.allclose(a[2], b[2])
    assert max(received) <= 12 * 8 * 4 * len(apart.base)  # twelve numbers a node and output; a histogram alone has 3 * 4 * 48
