"""All pairs of categories from one cube of counts: independence, exact tests, agreement and change, with the reasons of pairs left out."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import p_chi2
from .adjust import adjust_p
from .contingency import _fisher, label_chi_square, label_kappa

#: Fixed gates: rows of a pair, for independence and for agreement; disagreements from which McNemar's test takes chi-square.
LEAST_TABLE, LEAST_AGREEMENT, EXACT_BELOW = 5, 10, 25
NUMBER_LEVEL = r"^-?\d+(\.\d+)?$"


def category_cube(df: DataFrame, categories: list[str]) -> DataFrame:
    """a, b, x, y, n: rows by the levels of every pair of categories, counted in one pass; rows that miss either are left out.

    Tasks count first, so what is shuffled grows with the levels, not with the rows.
    """
    own = df.select([F.col(c).cast("string").alias(c) for c in categories])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in combinations(categories, 2)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, x string, y string, n long")
    return own.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))


def _all_pairs(df: DataFrame, categories: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(combinations(categories, 2)), "a string, b string")


def _frame(cube: DataFrame) -> DataFrame:
    """a, b, x, y, n, r, c: every level of a with every level of b, the cells without rows too; r and c are the rows of the levels."""
    rows = cube.groupBy("a", "b", "x").agg(F.sum("n").alias("r"))
    columns = cube.groupBy("a", "b", "y").agg(F.sum("n").alias("c"))
    return rows.join(columns, ["a", "b"]).join(cube, ["a", "b", "x", "y"], "left").fillna(0, ["n"])


def association_pairs(df: DataFrame, categories: list[str]) -> DataFrame:
    """a, b, n, n_rows, n_columns, statistic (Yates on 2x2), df, p, cramer_v, low_expected, least_expected, reliable, odds_ratio and fisher_p (2x2), reason.

    A row for every pair; those with fewer than five common rows or one level have a reason and no test.
    """
    frame = _frame(category_cube(df, categories))
    whole = Window.partitionBy("a", "b")
    cells = frame.withColumn("n_all", F.sum("n").over(whole)).withColumn("e", F.col("r").cast("double") * F.col("c") / F.col("n_all"))
    shape = cells.groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.count_distinct("x").alias("n_rows"), F.count_distinct("y").alias("n_columns"), F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("plain"),
        F.sum((F.abs(F.col("n") - F.col("e")) - F.least(F.lit(0.5), F.abs(F.col("n") - F.col("e")))) ** 2 / F.col("e")).alias("yates"), F.count_if(F.col("e") < 5).alias("low_expected"), F.min("e").alias("least_expected"),
        # of a 2x2 table the corners by name; of others nobody asks
        F.min_by("n", F.struct("x", "y")).alias("n11"), F.max_by("n", F.struct("x", "y")).alias("n22"), F.min_by("r", "x").alias("r1"), F.min_by("c", "y").alias("c1"),
    )
    square = (F.col("n_rows") == 2) & (F.col("n_columns") == 2)
    reason = F.when(F.coalesce("n", F.lit(0)) < LEAST_TABLE, f"fewer than {LEAST_TABLE} common rows").when((F.col("n_rows") < 2) | (F.col("n_columns") < 2), "one level")
    t = _all_pairs(df, categories).join(shape, ["a", "b"], "left").withColumn("reason", reason)
    fine = F.col("reason").isNull()
    t = t.withColumns({"statistic": F.when(fine, F.when(square, F.col("yates")).otherwise(F.col("plain"))), "df": F.when(fine, (F.col("n_rows") - 1) * (F.col("n_columns") - 1)), "n": F.coalesce("n", F.lit(0))})
    n12, n21 = F.col("r1") - F.col("n11"), F.col("c1") - F.col("n11")
    exact = fine & square
    return t.select(
        "a", "b", "n", "n_rows", "n_columns", "statistic", "df", F.when(fine, p_chi2(F.col("statistic"), F.col("df"))).alias("p"), F.sqrt(F.try_divide("statistic", F.col("n") * (F.least("n_rows", "n_columns") - 1))).alias("cramer_v"),
        F.when(fine, F.col("low_expected")).alias("low_expected"), F.when(fine, F.col("least_expected")).alias("least_expected"), F.when(fine, label_chi_square(F.col("low_expected"), F.col("n_rows"), F.col("n_columns"))).alias("reliable"),
        F.when(exact, F.try_divide(F.col("n11") * F.col("n22"), n12 * n21).cast("double")).alias("odds_ratio"), F.when(exact, _fisher(*[F.coalesce(x, F.lit(0)) for x in (F.col("n11"), n12, n21, F.col("n22"))])).alias("fisher_p"), "reason",
    )


def agreement_pairs(df: DataFrame, categories: list[str]) -> DataFrame:
    """a, b, n, levels, observed, expected, kappa, label, weighted_kappa, mcnemar, mcnemar_p with its corrections, reason.

    Only pairs with the same levels on both sides; of these, pairs with fewer than ten rows have a reason and no measures. Kappa is weighted (linear, levels by
    name) where there are three numeric levels or more, and McNemar's test is for two: exact below 25 disagreements, else with continuity correction.
    """
    frame = _frame(category_cube(df, categories))
    whole = Window.partitionBy("a", "b")
    sides = frame.groupBy("a", "b", "x").agg(F.first("r").alias("r")).withColumnRenamed("x", "level").join(frame.groupBy("a", "b", "y").agg(F.first("c").alias("c")).withColumnRenamed("y", "level"), ["a", "b", "level"], "full")
    same = sides.groupBy("a", "b").agg(F.bool_and(F.col("r").isNotNull() & F.col("c").isNotNull()).alias("same"), F.count("*").alias("k"), F.bool_and(F.col("level").rlike(NUMBER_LEVEL)).alias("numbers"), F.array_join(F.array_sort(F.collect_list("level")), ", ").alias("levels"))
    same = same.where("same").drop("same")
    placed = frame.join(same, ["a", "b"]).withColumns({"i": F.dense_rank().over(whole.orderBy("x")), "j": F.dense_rank().over(whole.orderBy("y")), "n_all": F.sum("n").over(whole)})
    e, far = F.col("r").cast("double") * F.col("c") / F.col("n_all"), F.abs(F.col("i") - F.col("j"))
    t = placed.groupBy("a", "b", "k", "numbers", "levels").agg(
        F.sum("n").alias("n"), F.sum(F.when(far == 0, F.col("n")).otherwise(0)).alias("o"), F.sum(F.when(far == 0, e).otherwise(0.0)).alias("e"), F.sum(far * F.col("n")).alias("wo"), F.sum(far * e).alias("we"),
        F.sum(F.when(F.col("i") < F.col("j"), F.col("n")).otherwise(0)).alias("up"), F.sum(F.when(F.col("i") > F.col("j"), F.col("n")).otherwise(0)).alias("down"),
    )
    reason = F.when(F.col("n") < LEAST_AGREEMENT, F.concat(F.lit("n="), F.col("n").cast("string"), F.lit(f" < {LEAST_AGREEMENT}")))
    t = t.withColumn("reason", reason)
    fine = F.col("reason").isNull()
    po, pe = F.col("o") / F.col("n"), F.col("e") / F.col("n")
    kappa = F.when(fine, F.try_divide(po - pe, 1 - pe))
    apart, least = F.col("up") + F.col("down"), F.least("up", "down")
    choose = F.aggregate(F.sequence(F.lit(0).cast("long"), F.when(apart < EXACT_BELOW, least).otherwise(0)), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), lambda s, x: F.struct((s["term"] * (apart - x) / (x + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")))["sum"]
    exact = F.least(F.lit(1.0), 2 * choose / F.pow(F.lit(2.0), apart))
    chi = F.try_divide(F.greatest(F.abs(F.col("up") - F.col("down")) - 1, F.lit(0)) ** 2, apart)
    two = fine & (F.col("k") == 2)
    found = t.select(
        "a", "b", "n", "levels", F.when(fine, po).alias("observed"), F.when(fine, pe).alias("expected"), kappa.alias("kappa"), F.when(kappa.isNotNull(), label_kappa(kappa)).alias("label"),
        F.when(fine & F.col("numbers") & (F.col("k") > 2), 1 - F.try_divide(F.col("wo"), F.col("we"))).alias("weighted_kappa"),
        F.when(two, F.when(apart < EXACT_BELOW, least.cast("double")).otherwise(chi)).alias("mcnemar"), F.when(two, F.when(apart < EXACT_BELOW, exact).otherwise(p_chi2(chi, F.lit(1)))).alias("p"), "reason",
    )
    return adjust_p(found).withColumnsRenamed({"p": "mcnemar_p"}).orderBy(F.desc_nulls_last("kappa"), "a", "b")


def skipped_pairs(tests: DataFrame, family: str) -> DataFrame:
    """test, reason: the rows of a table of pairs that were left out, for the common list of skipped tests."""
    return tests.where("reason is not null").select(F.concat(F.lit(f"{family}: "), "a", F.lit(" × "), "b").alias("test"), "reason")
