"""Separators among quotes, and the tables that a run writes."""

import pytest

from statloom.operators import describe, paired, report
from statloom.sources import tables


@pytest.mark.parametrize(("text", "columns"), [
    ('name;note\n"a;b;c;d";"x, y, z"\nb;"1, 2, 3"\n', ["name", "note"]),
    ('a,b\n"one; two; three; four",2\n"five; six; seven; eight",3\n', ["a", "b"]),
    ("a|b|c\n1,5|2,5|3,5\n4,5|5,5|6,5\n", ["a", "b", "c"]),
    ("a\tb\n1 , 2 , 3\t4\n5\t6\n", ["a", "b"]),
    ('a,b\n"say ""hi, you""",2\n', ["a", "b"]),
    ("only\n1\n2\n", ["only"]),
])
def test_separators_are_counted_outside_quotes(spark, tmp_path, text, columns):
    path = tmp_path / "t.csv"
    path.write_text(text)
    assert tables.load_csv(spark, str(path)).columns == columns


def test_results_are_written_with_what_was_left_out(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i * i % 7), "same") for i in range(4)], "x double, y double, c string")
    pairs = paired.paired_tests(df, ["x", "y"])
    tables.save_tables({"paired": pairs, "nothing": pairs.limit(0)}, str(tmp_path), variables=describe.detect_variables(df), skipped=report.skipped_tests({"paired": (pairs, ["a", "b"])}))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}").collect()
    assert read("nothing")[0]["note"] == "no rows" and {r["variable"]: r["reason"] for r in read("variables")}["c"] == "constant"
    assert [(r["family"], r["test"], r["reason"]) for r in read("skipped_tests")] == [("paired", "x × y", "n=4 < 5")]


def test_a_code_that_is_listed_twice_repeats_no_row(spark):
    labels = spark.createDataFrame([("g", "1", "one"), ("g", "1", "eins"), ("g", "2", "two")], "variable string, value string, label string")
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "g double")
    assert sorted(r["g"] for r in tables.decode_labels(df, labels, ["g"]).collect()) == ["3.0", "eins", "two"]
