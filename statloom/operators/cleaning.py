"""Cleaning steps in their order: repeated rows, constant columns, sparse rows, extreme outliers, missing counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FENCE, MISSING_SHARE = 3.0, 0.5


def drop_repeats(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def constant_columns(df: DataFrame) -> DataFrame:
    """variable for each column with at most one distinct value; minimum and maximum tell, so nothing is gathered."""
    s = df.agg(F.array(*[F.struct(F.lit(c).alias("variable"), F.min(F.col(c).cast("string")).eqNullSafe(F.max(F.col(c).cast("string"))).alias("constant")) for c in df.columns]).alias("s"))
    return s.select(F.inline("s")).where("constant").select("variable")


def drop_sparse(df: DataFrame, columns: list[str], share: float = MISSING_SHARE) -> DataFrame:
    """Without the rows in which more than ``share`` of the columns are missing."""
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    return df.where(missing <= share * len(columns))


def outlier_fences(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """variable, low, high: three interquartile ranges beyond the quartiles; none where they are equal."""
    from .describe import long_form
    from .ranks import quantiles

    long = long_form(df, columns)
    q = quantiles(long, ["variable"], "value", [0.25, 0.75]) if exact else long.groupBy("variable").agg(F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.where(iqr > 0).select("variable", (F.col("q")[0] - FENCE * iqr).alias("low"), (F.col("q")[1] + FENCE * iqr).alias("high"))


def null_outliers(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """df with extreme values made null; the fences are a row per column."""
    fences = {r["variable"]: (r["low"], r["high"]) for r in outlier_fences(df, columns, exact).collect()}
    return df.withColumns({c: F.when(F.col(c).between(*fences[c]), F.col(c)) for c in columns if c in fences})


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    s = df.agg(F.array(*[F.struct(F.lit(c).alias("variable"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.count("*").alias("n_rows")) for c in columns]).alias("s"))
    return s.select(F.inline("s"))


def cleaning_report(df: DataFrame, columns: list[str], share: float = MISSING_SHARE) -> DataFrame:
    """step, n_before, n_after, cells: what each step of the chain does, in order: repeated rows, sparse rows, then extreme values made null."""
    distinct = drop_repeats(df)
    kept = drop_sparse(distinct, columns, share)
    inside = null_outliers(kept, columns)
    known = lambda d: d.agg(F.count("*").alias("n"), reduce(lambda a, b: a + b, [F.count(c) for c in columns]).alias("cells"))
    steps = [known(d).withColumn("i", F.lit(i)) for i, d in enumerate((df, distinct, kept, inside))]
    counts = reduce(DataFrame.unionByName, steps)
    one, two = counts.alias("one"), counts.alias("two")
    name = F.element_at(F.array(F.lit("drop_repeats"), F.lit("drop_sparse"), F.lit("null_outliers")), F.col("two.i"))
    return one.join(two, F.col("two.i") == F.col("one.i") + 1).select(name.alias("step"), F.col("one.n").alias("n_before"), F.col("two.n").alias("n_after"), (F.col("one.cells") - F.col("two.cells")).alias("cells"))


def outlier_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, n_outliers: how many values the fences of each column leave out; columns without fences have none."""
    from .describe import long_form

    fenced = long_form(df, columns).join(F.broadcast(outlier_fences(df, columns)), "variable", "left")  # a row per column
    return fenced.groupBy("variable").agg(F.count_if(~F.col("value").between(F.col("low"), F.col("high"))).alias("n_outliers"))


def down_sampled(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """The ``most`` rows with the smallest hashes of key and seed, for methods that need a bounded sample; smaller tables stay whole."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)
