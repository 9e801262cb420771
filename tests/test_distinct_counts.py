"""Distinct values are counted over bounded parts: as Spark counts them, and without a map of all values of a task."""

import pytest
from pyspark.sql import functions as F

from statloom.operators import describe, kinds


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(describe, "TASK_VALUES", 100)
    monkeypatch.setattr(describe, "MERGED_ROWS", 32)


@pytest.fixture
def odd(spark):
    """Zeros of both signs, NaN, missing and frequent values, and columns of many types."""
    return spark.range(300).selectExpr(
        "id - 5 as follows", "id * 3 as apart", "case when id = 0 then -0.0D when id < 200 then 0.0D else id end as zeros", "if(id % 4 = 0, double('NaN'), id % 7) as gaps", "if(id % 3 = 0, null, concat('t', id % 90)) as words",
        "cast(null as string) as nothing", "cast(id % 11 as decimal(9, 2)) as money", "date_add(date'2020-01-01', int(id % 13)) as day", "timestamp_seconds(id % 17) as time", "id % 2 = 0 as yes", "cast(id % 23 as float) as small", "id % 19 as `with.dot`",
        "array(id % 5) as list", "make_ym_interval(int(id % 6)) as months", "cast(concat(id, ',0') as string) as comma", "-double(id) as down",
    )


def test_counts_equal_sparks_own(odd, few):
    clean = describe.clean_numbers(odd.drop("with.dot"))
    want = clean.agg(*[F.count_distinct(c).alias(c) for c in clean.columns]).first().asDict()
    assert describe.distinct_counts(clean, clean.agg(*[F.count(c).alias(c) for c in clean.columns]).first().asDict()) == want
    assert describe.distinct_counts(odd, {"with.dot": 300}) == {"with.dot": 19}
    assert {r["variable"]: r["n_unique"] for r in kinds.infer_kinds(odd).collect()} == want | {"with.dot": 19}
    found = {r["variable"]: (r["reason"], r["n_unique"]) for r in describe.detect_variables(odd.drop("with.dot")).collect()}
    assert {c: found[c][0] for c in ("follows", "apart", "zeros", "comma", "down")} == {"follows": "id", "apart": None, "zeros": None, "comma": "id", "down": "id"}
    assert found["nothing"] == ("all missing", 0) and found["zeros"][1] == want["zeros"]


def test_no_task_gathers_the_values_of_a_table(spark, few, monkeypatch):
    df, plans = spark.range(1000).selectExpr("id", "id * 2 as even"), []
    real = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or real(self))
    for query in (describe.detect_variables, kinds.infer_kinds):
        plans.clear()
        query(df)
        assert not any("Expand" in plan for plan in plans)  # a distinct count over several columns
        by_value = [plan for plan in plans if "RepartitionByExpression" in plan]
        assert len(by_value) == (2 if query is describe.detect_variables else 1)
        for plan, values in zip(by_value, (2000, 4000), strict=False):
            # values are dealt to a number of tasks that follows theirs (the first is a sketch's), and grouped only after that
            tasks = int(plan.split("RepartitionByExpression")[1].split("\n")[0].rsplit("], ", 1)[1])
            assert plan.rindex("Aggregate") < plan.index("RepartitionByExpression") and tasks == pytest.approx(values / 100, rel=0.2)


def test_two_levels_without_gathering_values(spark, monkeypatch):
    rows = [(float("nan"), "a", 0.0, 1), (float("nan"), "b", -0.0, 2), (1.0, "b", 1.0, 3), (1.0, None, None, 3)]
    df, plans = spark.createDataFrame(rows, "n double, s string, z double, three int"), []
    real = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or real(self))
    assert kinds.code_binary(df, ["n", "s", "z", "three"])[1] == {"n": "n (NaN=1)", "s": "s (b=1)", "z": "z (1.0=1)"}
    assert plans and not any("Expand" in plan for plan in plans)
    assert kinds.code_binary(df.where("n < 0"), ["n", "s"])[1] == {}
