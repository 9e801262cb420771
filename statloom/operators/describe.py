"""Typing, descriptives, frequencies and normality from moments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import p_chi2, t_critical
from .ranks import quantiles

#: Fixed thresholds of the typing rules.
NUMERIC_DISTINCT, CATEGORY_DISTINCT, TEXT_SHARE = 7, 25, 0.9
#: Values that one task compares on average, and the rows and bytes whose equal values are merged before they are shuffled.
TASK_VALUES, MERGED_ROWS, MERGED_BYTES = 1 << 19, 1 << 17, 1 << 24
_COMPARED = T.NumericType | T.StringType | T.BooleanType | T.BinaryType | T.DateType | T.TimestampType | T.TimestampNTZType | T.DayTimeIntervalType


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN counts as missing: make it null once."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def _number(c: str) -> F.Column:
    return F.expr(f"try_cast(regexp_replace(trim(cast(`{c}` as string)), ',', '.') as double)")


def _tasks(values: int) -> int:
    return -(-values // TASK_VALUES) or 1


def values_sent(df: DataFrame, c: str) -> F.Column:
    """About how many values of a column are left once equal ones are merged, from a sketch of fixed size; 0 only without values."""
    n = F.count(f"`{c}`")
    return F.least(n, F.approx_count_distinct(f"`{c}`") * (F.floor(n / MERGED_ROWS) + 1)) if isinstance(df.schema[c].dataType, _COMPARED) else n


def distinct_counts(df: DataFrame, sent: dict[str, int]) -> dict[str, int]:
    """How many distinct values each column has, exactly, from the columns and their ``values_sent``.

    Tasks merge equal values of some rows at a time, so frequent values meet in few copies; then values are dealt to as many tasks as
    those left need. So neither a map of all values of a scan's task nor one of a shuffle's grows with the table. Nested columns, and
    others that Arrow can't compare, are left to Spark's own count.
    """
    asked = [c for c, n in sent.items() if n and isinstance(df.schema[c].dataType, _COMPARED)]
    others = [c for c, n in sent.items() if n and c not in asked]
    found = dict.fromkeys(sent, 0) | (df.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in others]).first().asDict() if others else {})
    if not asked:
        return found
    types = list(dict.fromkeys(df.schema[c].dataType for c in asked))
    slots = [types.index(df.schema[c].dataType) for c in asked]

    def merged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        for i, slot in enumerate(slots):
            own = rows.column(i).unique().drop_null()
            row = [pa.repeat(pa.scalar(i, pa.int32()), len(own)), *[own if j == slot else pa.nulls(len(own), rows.column(slots.index(j)).type) for j in range(len(types))]]
            yield pa.RecordBatch.from_arrays(row, names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= MERGED_ROWS or size >= MERGED_BYTES:
                yield from merged(held)
                held, rows, size = [], 0, 0
        if held:
            yield from merged(held)

    names = ["variable", *[f"v{j}" for j in range(len(types))]]
    schema = T.StructType([T.StructField(name, t) for name, t in zip(names, [T.IntegerType(), *types], strict=True)])
    values = df.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(asked)]).mapInArrow(work, schema)
    dealt = values.repartition(_tasks(sum(sent[c] for c in asked)), *names).distinct()
    # a row per column of the table reaches the driver
    return found | {asked[r["variable"]]: r["n"] for r in dealt.groupBy("variable").agg(F.count("*").alias("n")).collect()}


def detect_variables(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """variable, kind (numeric, categorical or skipped), reason, n, n_missing, n_unique; all columns share each pass over the table."""
    df = clean_numbers(df)
    columns = columns or df.columns
    numeric = {f.name: isinstance(f.dataType, T.NumericType | T.BooleanType) for f in df.schema}
    numbers = {c: f"_number{i}" for i, c in enumerate(columns)}
    # numbers are read from texts once, below the aggregate
    read = df.withColumns({name: F.col(c).cast("int").cast("double") if isinstance(df.schema[c].dataType, T.BooleanType) else F.col(c).cast("double") if numeric[c] else _number(c) for c, name in numbers.items()})
    stats = []
    for c in columns:
        value, as_number = F.col(c), F.col(numbers[c])
        stats.append(F.struct(
            F.lit(c).alias("variable"), F.lit(numeric[c]).alias("is_number"), F.count(value).alias("n"), F.count_if(value.isNull()).alias("n_missing"),
            F.count(as_number).alias("n_numbers"), F.count_if(as_number % 1 != 0).alias("n_fractions"), values_sent(df, c).alias("sent"),
        ))
    # one row per column of the table reaches the driver, from one aggregate without groups
    profile = read.agg(F.array(*stats).alias("s")).select(F.inline("s")).collect()
    unique = distinct_counts(df, {r["variable"]: r["sent"] for r in profile})
    number = {r["variable"]: r["is_number"] or r["n"] > 0 and r["n_numbers"] >= TEXT_SHARE * r["n"] for r in profile}
    # only columns of distinct integers are looked at again: how many of them follow another
    may_count = [r["variable"] for r in profile if number[r["variable"]] and unique[r["variable"]] == r["n"] == r["n_numbers"] and r["n_fractions"] == 0 and r["n"] > 1]
    followers = _followers(df, {c: numeric[c] for c in may_count}, sum(r["n"] for r in profile if r["variable"] in may_count)) if may_count else {}
    found = []
    for r in profile:
        c, n_unique = r["variable"], unique[r["variable"]]
        # the median gap of sorted distinct integers is 1 if more than half of the gaps are
        serial = c in followers and followers[c] >= (r["n"] - 1) // 2 + 1
        reason = (
            "all missing" if r["n"] == 0 else "constant" if n_unique <= 1 else "id" if serial
            else "free text or id" if not number[c] and n_unique > CATEGORY_DISTINCT else None
        )
        kind = "skipped" if reason else "numeric" if number[c] and n_unique >= NUMERIC_DISTINCT else "categorical"
        found.append((c, kind, reason, r["n"], r["n_missing"], n_unique))
    return df.sparkSession.createDataFrame(found, "variable string, kind string, reason string, n long, n_missing long, n_unique long")


def _followers(df: DataFrame, is_number: dict[str, bool], n: int) -> dict[str, int]:
    """How many values of each column of distinct integers, ``n`` in all, are one more than another: values and their successors meet by value.

    They are dealt to as many tasks as they need before they are counted; no value comes more than twice.
    """
    own = [F.col(c).cast("double") if number else _number(c) for c, number in is_number.items()]
    both = [F.struct(F.lit(i).alias("variable"), v.alias("v")) for i, value in enumerate(own) for v in (value, value + 1)]
    dealt = df.select(F.inline(F.array(*both))).where("v is not null").repartition(_tasks(2 * n), "variable", "v")
    found = dealt.groupBy("variable", "v").agg(F.count("*").alias("n")).groupBy("variable").agg(F.count_if(F.col("n") == 2).alias("followers")).collect()
    return {list(is_number)[r["variable"]]: r["followers"] for r in found}


def as_number(df: DataFrame, c: str) -> F.Column:
    """A column as numbers; texts may have a decimal comma, and what is no number is missing."""
    return _number(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("double")


def long_form(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, variable, value: a row for each known value."""
    numbers = clean_numbers(df).select(*(keys or []), *[as_number(df, c).alias(c) for c in columns])
    return numbers.unpivot(keys or [], columns, "variable", "value").where("value is not null")


def describe_numeric(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Moments, quartiles and shape of each column; exact quartiles come from ranks of counted values, others from a sketch."""
    long = long_form(df, columns)
    sketch = [] if exact else [F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")]
    rows = long.groupBy("variable").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), *sketch, F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"),
    )
    if exact:
        rows = rows.join(F.broadcast(quantiles(long, ["variable"], "value", [0.25, 0.5, 0.75])), "variable")  # a row per column
    n = F.col("n")
    q = lambda i: F.col("q")[i]
    return rows.select(
        "variable", "n", "mean", "sd", (F.col("sd") / F.sqrt(n)).alias("se"), q(1).alias("median"), q(0).alias("q1"), q(2).alias("q3"), (q(2) - q(0)).alias("iqr"), "min", "max", (F.col("max") - F.col("min")).alias("range"),
        F.when(n > 2, F.col("skew")).alias("skewness"), F.when(n > 3, F.col("kurt")).alias("kurtosis"), (100 * F.col("sd") / F.nullif(F.abs("mean"), F.lit(0.0))).alias("cv_percent"),
    )


def with_interval(described: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The t interval of the mean; it is the mean itself where n is 1 or nothing varies."""
    half = F.when((F.col("n") > 1) & (F.col("sd") > 0), t_critical(F.col("n") - 1, alpha) * F.col("se")).otherwise(F.lit(0.0))
    return described.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def outlier_counts(df: DataFrame, columns: list[str], width: float = 3.0) -> DataFrame:
    """variable, n_outliers beyond ``width`` interquartile ranges from the quartiles; none where that range is zero."""
    long = long_form(df, columns)
    q = quantiles(long, ["variable"], "value", [0.25, 0.75])
    reach = width * (F.col("q")[1] - F.col("q")[0])
    beyond = (reach > 0) & ((F.col("value") < F.col("q")[0] - reach) | (F.col("value") > F.col("q")[1] + reach))
    return long.join(F.broadcast(q), "variable").groupBy("variable").agg(F.count_if(beyond).alias("n_outliers"))  # a row per column


def describe_fully(df: DataFrame, columns: list[str]) -> DataFrame:
    """The whole table of descriptives: moments and quartiles with their interval, missing values, outliers, four tests of normality and the verdict."""
    from .normality import distribution_tests, normality, verdict

    missing = df.select(*[as_number(df, c).alias(c) for c in columns]).agg(F.array(*[F.struct(F.lit(c).alias("variable"), F.count_if(F.col(c).isNull() | F.isnan(c)).alias("n_missing")) for c in columns]).alias("m")).select(F.inline("m"))
    tests = normality(df, columns)
    others = distribution_tests(long_form(df, columns), ["variable"])
    jb = moment_tests(df, columns).select("variable", p_chi2(F.col("jarque_bera"), F.lit(2.0)).alias("jarque_bera_p"))
    out = with_interval(describe_numeric(df, columns)).join(missing, "variable").join(outlier_counts(df, columns), "variable", "left")
    for more in (tests, others.drop("n"), jb):
        out = out.join(more.drop(*[c for c in more.columns if c != "variable" and c in out.columns]), "variable", "left")
    return out.withColumn("normal", verdict(F.col("p")))


def moment_statistics(n: F.Column, g1: F.Column, g2: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """Jarque-Bera and the z of skewness and of kurtosis, from the count and the biased moments."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    scaled = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(scaled + F.sqrt(scaled**2 + 1)) / F.sqrt(F.log(F.sqrt(w2)))
    mean = 3 * (n - 1) / (n + 1) - 3
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 - mean) / F.sqrt(variance)
    root = 6 * (n**2 - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / root**2))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), 1 / 3)) / F.sqrt(2 / (9 * a))
    return n / 6 * (g1**2 + g2**2 / 4), z1, z2


def moment_tests(df: DataFrame, columns: list[str]) -> DataFrame:
    """Jarque-Bera and D'Agostino's K2 from moments: variable, n, jarque_bera, z_skew, z_kurt, k2."""
    return moment_tests_of(long_form(df, columns), ["variable"])


def moment_tests_of(long: DataFrame, keys: list[str]) -> DataFrame:
    """The same for each group of a long table, from 20 values that vary."""
    m = long.groupBy(*keys).agg(F.count("value").alias("n"), F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"), F.stddev_samp("value").alias("_sd")).where("n >= 20 and _sd > 0")
    jb, z1, z2 = moment_statistics(F.col("n"), F.col("_g1"), F.col("_g2"))
    return m.select(*keys, "n", jb.alias("jarque_bera"), z1.alias("z_skew"), z2.alias("z_kurt"), (z1**2 + z2**2).alias("k2"))


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, level, n, percent, n_levels by falling count; ties by level."""
    texts = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "variable", "level").where("level is not null")
    counts = texts.groupBy("variable", "level").agg(F.count("*").alias("n"))
    own = Window.partitionBy("variable")
    return counts.select("variable", "level", "n", (100 * F.col("n") / F.sum("n").over(own)).alias("percent"), F.count("*").over(own).alias("n_levels"))


def equal_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Chi-square of each column's levels against equal shares: variable, statistic, df."""
    f = frequencies(df, columns)
    expected = F.sum("n").over(Window.partitionBy("variable")) / F.col("n_levels")
    return f.withColumn("part", (F.col("n") - expected) ** 2 / expected).groupBy("variable").agg(F.sum("part").alias("statistic"), (F.count("*") - 1).alias("df"))


def with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", p_chi2(F.col("statistic"), F.col("df")))
