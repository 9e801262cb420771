"""Reading tables by suffix, delimited text of unknown separator and encoding, and writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order they are tried.
ENCODINGS = ["utf-8", "windows-1254", "iso-8859-1"]
#: Bytes that windows-1254 leaves without a letter.
UNUSED_1254 = "[\\x{81}\\x{8d}-\\x{90}\\x{9d}\\x{9e}]"
SEPARATORS = [",", ";", "\t", "|"]


#: A quoted part of a line, doubled quotes included; what is quoted doesn't separate.
QUOTED = '"(?:[^"]|"")*"'


def _sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """Separator and encoding, both from all lines by one distributed aggregate.

    The separator is the one that divides every line alike: of those that occur outside quotes on every line or so, that whose number varies least from line to line
    compared with its mean; of equals the more frequent. A file where none occurs has one column.
    """
    raw = F.col("value").cast("binary")
    bare = F.regexp_replace(F.decode(raw, "ISO-8859-1"), QUOTED, "")
    lines = spark.read.text(path).select("value", raw.alias("raw"), bare.alias("bare")).where(F.length("value") > 0)
    number = lambda s: F.length("bare") - F.length(F.replace(F.col("bare"), F.lit(s), F.lit("")))
    found = lines.agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("no_utf8"), F.bool_or(F.decode("raw", "ISO-8859-1").rlike(UNUSED_1254)).alias("no_1254"),
        *[f(number(s)).alias(f"{name}{i}") for i, s in enumerate(SEPARATORS) for name, f in (("m", F.avg), ("sd", F.stddev_pop))],
    ).first()
    encoding = ENCODINGS[0] if not found["no_utf8"] else ENCODINGS[2] if found["no_1254"] else ENCODINGS[1]
    steady = [(found[f"sd{i}"] / found[f"m{i}"], -found[f"m{i}"], i) for i in range(len(SEPARATORS)) if (found[f"m{i}"] or 0) >= 0.5]
    return SEPARATORS[min(steady)[2]] if steady else SEPARATORS[0], encoding


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    separator, encoding = _sniff(spark, path)
    if encoding != "utf-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.csv(path, sep=separator, encoding=encoding, header=True, inferSchema=True)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix; an unknown suffix or an empty table is an error."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "txt", "tsv"):
        df = load_csv(spark, path)
    elif kind in ("parquet", "json", "orc"):
        df = spark.read.format(kind).load(path)
    else:
        raise ValueError(f"unsupported suffix: {kind}")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def decode_labels(df: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Replace codes by labels (variable, value, label): by the code as it is, then as an integer; others stay. Of a code that is listed twice the first label in order counts."""
    for c in columns:
        own = labels.where(F.col("variable") == c).groupBy(F.col("value").alias("_v")).agg(F.min("label").alias("_l"))
        code = F.col(c).cast("string")
        whole = F.expr(f"cast(try_cast(`{c}` as bigint) as string)")
        one = df.join(own, code == F.col("_v"), "left").withColumnRenamed("_l", "_l1").drop("_v")
        df = one.join(own, whole == F.col("_v"), "left").withColumn(c, F.coalesce("_l1", "_l", code)).drop("_v", "_l", "_l1")
    return df


def save_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet", variables: DataFrame | None = None, skipped: DataFrame | None = None) -> None:
    """One directory per result table; an empty table becomes one row that says so. ``variables`` (with the reason of skipped columns) and ``skipped`` tests
    (family, test, reason) are tables of their own."""
    more = {"variables": variables, "skipped_tests": skipped}
    for name, df in (tables | {k: v for k, v in more.items() if v is not None}).items():
        out = df if not df.isEmpty() else df.sparkSession.createDataFrame([("no rows",)], "note string")
        out.write.mode("overwrite").format(form).save(f"{path.rstrip('/')}/{name}")


def load_with_metadata(spark: SparkSession, path: str, labels: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A table, its variables (variable, label, measure) and its value labels (variable, value, label), from a JSON file beside it.

    The file has an object for each variable: variable, label, measure and values, a map from code to label.
    """
    df = load_table(spark, path)
    schema = "variable string, label string, measure string, values map<string,string>"
    meta = spark.read.schema(schema).json(labels) if labels else spark.createDataFrame([], schema)
    return df, meta.select("variable", "label", "measure"), meta.select("variable", F.explode("values").alias("value", "label"))


def named(results: DataFrame, variables: DataFrame, columns: list[str]) -> DataFrame:
    """results with the display name of each of the columns that hold a variable: its label, or else its name. A row per variable."""
    known = variables.where("label <> ''").select(F.col("variable").alias("_v"), F.col("label").alias("_l")).dropDuplicates(["_v"])
    for c in columns:
        results = results.join(known, F.col(c) == F.col("_v"), "left").withColumn(c, F.coalesce("_l", c)).drop("_v", "_l")
    return results
