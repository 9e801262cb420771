"""Cuts are searched in two steps, with the result of a plain count."""

from statloom.operators import neighbours


def test_two_steps_count_the_cuts_below(spark):
    for n in (0, 1, 2, 3, 10, 101):
        cuts = [float(i) for i in range(n)]
        rows = spark.createDataFrame([(cuts, v / 2) for v in range(-3, 2 * n + 4)], "cuts array<double>, v double")
        for r in rows.select("v", neighbours._below("v").alias("got")).collect():
            assert r["got"] == sum(c < r["v"] for c in cuts)
