"""The registered way from a table to findings runs, and a pair of categories is found in the order of its plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from statloom.operators import findings

DATA = "/root/testdata/sf0.001"


def test_the_registered_findings_have_a_result_for_every_planned_test(spark):
    found = {(r["family"], r["dv"], r["iv"]): r for r in entry.queries()["planned_findings"](spark, DATA).collect()}
    assert ("group", "o_totalprice", "o_orderstatus") in found
    association = found["association", "o_orderstatus", "o_orderpriority"]
    cells = spark.read.parquet(f"{DATA}/orders.parquet").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).toPandas().pivot(index="o_orderstatus", columns="o_orderpriority", values="n").fillna(0).to_numpy()
    expected = np.outer(cells.sum(1), cells.sum(0)) / cells.sum()
    assert association["error"] is None and association["n"] == cells.sum()
    if association["test"] == "chi_square":
        assert association["statistic"] == pytest.approx(((cells - expected) ** 2 / expected).sum(), rel=1e-6)


def test_both_orders_of_a_pair_of_categories(spark):
    rows = spark.createDataFrame([("x" if i % 2 else "y", "p" if i % 3 else "q") for i in range(120)], "later string, first string")
    found = {(r["dv"], r["iv"], r["test"]): r["statistic"] for r in findings.association_results(rows, ["later", "first"]).collect()}
    for test in {t for _, _, t in found}:
        assert found["later", "first", test] == found["first", "later", test]
    assert found
