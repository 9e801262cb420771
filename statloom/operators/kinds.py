"""The seven-kind typing of variables, with metadata and overrides, and the discovery of outcomes and predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .describe import clean_numbers, distinct_counts, values_sent

#: Fixed names and limits of the typing rules.
KINDS = ["continuous", "ordinal", "nominal", "binary", "id", "date", "excluded"]
ROLES = ["auto", "dv", "iv", "exclude"]
ID_NAME = r"(?i)^(id|no|num|sira|sıra|subject|subj|kod|katilimci|katılımcı)([_ ]?(no|id))?$"
TEXT_LEVELS, LABEL_LEVELS, ORDINAL_LEVELS, ID_SHARE, LEAST_ID_ROWS = 12, 10, (3, 7), 0.9, 10


def _profile(df: DataFrame) -> DataFrame:
    """A row per column, from one aggregate over the table and its distinct values."""
    stats = []
    for field in df.schema:
        c, number = F.col(f"`{field.name}`"), isinstance(field.dataType, T.NumericType | T.BooleanType)
        value = c.cast("int") if isinstance(field.dataType, T.BooleanType) else c
        whole = F.coalesce(F.bool_and(value.cast("double") % 1 == 0), F.lit(False)) if number else F.lit(False)
        stats.append(F.struct(
            F.lit(field.name).alias("variable"), F.lit(number).alias("is_number"), F.lit(isinstance(field.dataType, T.DateType | T.TimestampType | T.TimestampNTZType)).alias("is_date"),
            F.count(value).alias("n"), F.count_if(value.isNull()).alias("n_missing"), whole.alias("whole"), values_sent(df, field.name).alias("sent"),
        ))
    found = df.agg(F.array(*stats).alias("s")).select(F.inline("s")).collect()
    unique = distinct_counts(df, {r["variable"]: r["sent"] for r in found})
    schema = "variable string, is_number boolean, is_date boolean, n long, n_missing long, whole boolean, n_unique long"
    return df.sparkSession.createDataFrame([(*r[:-1], unique[r["variable"]]) for r in found], schema)


def ordered_labels(keys: Column) -> Column:
    """Whether label keys are numbers without gaps."""
    numbers = F.array_sort(F.transform(keys, lambda k: k.try_cast("double")))
    steps = F.zip_with(F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda a, b: a - b)
    return (F.size(keys) > 1) & F.forall(numbers, lambda v: v.isNotNull()) & F.forall(steps, lambda d: d == 1)


def infer_kinds(df: DataFrame, measures: DataFrame | None = None, value_labels: DataFrame | None = None) -> DataFrame:
    """variable, kind, n, n_missing, n_unique.

    ``measures`` (variable, measure: scale, ordinal or nominal) and ``value_labels`` (variable, value, label) are hints with a row
    per variable or label.
    """
    rows = _profile(clean_numbers(df))
    if measures is not None:
        rows = rows.join(F.broadcast(measures.select("variable", "measure").dropDuplicates(["variable"])), "variable", "left")
    else:
        rows = rows.withColumn("measure", F.lit(None).cast("string"))
    if value_labels is not None:
        keys = value_labels.groupBy("variable").agg(F.collect_set(F.col("value").cast("string")).alias("keys"))
        rows = rows.join(F.broadcast(keys), "variable", "left")
    else:
        rows = rows.withColumn("keys", F.lit(None).cast("array<string>"))
    n, u, number, whole = F.col("n"), F.col("n_unique"), F.col("is_number"), F.col("whole")
    named = F.col("variable").rlike(ID_NAME)
    scale = F.coalesce(F.col("measure") == "scale", F.lit(False))
    identity = (n > LEAST_ID_ROWS) & (u >= ID_SHARE * n) & (named | (u == n) & (~number | whole & ~scale))
    text = F.when(u == 2, "binary").when(u <= TEXT_LEVELS, "nominal").otherwise("excluded")
    nominal = F.when(u == 2, "binary").when(u <= TEXT_LEVELS, "nominal").otherwise("excluded")
    hinted = F.when(scale & (u > 2), "continuous").when(F.col("measure") == "ordinal", F.when(u <= 2, "binary").otherwise("ordinal")).when(F.col("measure") == "nominal", nominal)
    labelled = F.size(F.coalesce("keys", F.array().cast("array<string>"))) > 0
    ordered = F.coalesce(ordered_labels(F.col("keys")), F.lit(False))
    data = (
        F.when(u == 2, "binary").when(labelled & (u <= LABEL_LEVELS), F.when(whole & ordered, "ordinal").otherwise("nominal"))
        .when(whole & u.between(*ORDINAL_LEVELS), "ordinal").when(u > ORDINAL_LEVELS[1], "continuous").otherwise("nominal")
    )
    kind = F.when(F.col("is_date"), "date").when(u <= 1, "excluded").when(identity, "id").when(~number, text).otherwise(F.coalesce(hinted, data))
    return rows.select("variable", kind.alias("kind"), "n", "n_missing", "n_unique")


def override_kinds(kinds: DataFrame, overrides: DataFrame) -> DataFrame:
    """Kinds and roles replaced by a table (variable, kind, role); values that don't exist are ignored."""
    own = overrides.select("variable", F.when(F.col("kind").isin(KINDS), F.col("kind")).alias("_kind"), F.when(F.col("role").isin(ROLES), F.col("role")).alias("_role")).dropDuplicates(["variable"])
    joined = kinds.join(F.broadcast(own), "variable", "left")
    role = F.coalesce("_role", "role") if "role" in kinds.columns else F.coalesce("_role", F.lit("auto"))
    return joined.withColumns({"kind": F.coalesce("_kind", "kind"), "role": role}).drop("_kind", "_role")


def integrity(n_rows: Column, n_usable: Column) -> Column:
    """The issues of a table: too few rows or variables block, few rows warn."""
    found = F.array(
        F.when(n_rows < 10, F.struct(F.lit("block").alias("severity"), F.lit("fewer than 10 rows").alias("message"))), F.when(n_usable < 2, F.struct(F.lit("block").alias("severity"), F.lit("fewer than 2 usable variables").alias("message"))),
        F.when((n_rows >= 10) & (n_rows < 30), F.struct(F.lit("warn").alias("severity"), F.lit("fewer than 30 rows").alias("message"))),
    )
    return F.array_compact(found)


def binary_outcomes(df: DataFrame, columns: list[str], least: int = 5) -> DataFrame:
    """variable, event, n_event, n: columns with two levels of ``least`` rows or more; the rarer level is the event, ties go to the later name."""
    levels = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "variable", "level").where("level is not null")
    counts = levels.groupBy("variable", "level").agg(F.count("*").alias("n"))
    two = counts.withColumn("k", F.count("*").over(Window.partitionBy("variable"))).where("k = 2")
    rarer = F.array_sort(F.collect_list(F.struct("n", "level")), lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] < b["n"], -1).otherwise(1)).otherwise(F.when(a["level"] > b["level"], -1).otherwise(1)))
    first = two.groupBy("variable").agg(rarer[0].alias("e"), F.min("n").alias("low"), F.sum("n").alias("n"))
    return first.where(F.col("low") >= least).select("variable", F.col("e.level").alias("event"), F.col("e.n").alias("n_event"), "n")


def code_binary(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with a 0/1 column for each two-level column, 1 for the level that comes second by name; and the names of those columns.

    Only columns with two levels are coded; a row per column reaches the driver.
    """
    low, high = ([f"_{end}{i}" for i in range(len(columns))] for end in ("low", "high"))
    ends = df.agg(*[f(c).alias(name) for f, names in ((F.min, low), (F.max, high)) for c, name in zip(columns, names, strict=True)])
    # two levels are the least and the greatest value; that row tells, so no values are gathered
    two = lambda c, a, b: F.coalesce(F.max(F.col(a) < F.col(b)), F.lit(False)) & (F.count_if((F.col(c) != F.col(a)) & (F.col(c) != F.col(b))) == 0)
    s = df.crossJoin(F.broadcast(ends)).agg(F.array(*[F.struct(F.lit(c).alias("c"), F.max(F.col(c).cast("string")).alias("high"), two(c, a, b).alias("two")) for c, a, b in zip(columns, low, high, strict=True)]).alias("s"))
    found = {r["c"]: r["high"] for r in s.select(F.inline("s")).where("two").collect()}
    names = {c: f"{c} ({level}=1)" for c, level in found.items()}
    coded = {names[c]: F.when(F.col(c).isNotNull(), (F.col(c).cast("string") == level).cast("double")) for c, level in found.items()}
    return df.withColumns(coded) if coded else df, names
