"""Hidden structure: mutual information, clusters and anomalies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .correlate import pearson_pairs
from .describe import clean_numbers, describe_numeric

#: Fixed limits of the layer.
LEAST_ROWS, REDUNDANT, STRONG_MI, STRONG_GAP, SEED = 25, 0.95, 0.30, 0.10, 42
TREES, TREE_ROWS, TOP_ANOMALIES, TOP_REASONS = 100, 256, 25, 4


def binned(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """A bin number per column, by approximate quantiles; values equal to an edge fall below it."""
    own = clean_numbers(df).select([F.col(c).cast("double").alias(c) for c in columns])
    marks = [i / bins for i in range(1, bins)]
    edges = own.agg(*[F.array_distinct(F.percentile_approx(c, marks, 10_000)).alias(f"_e{i}") for i, c in enumerate(columns)])  # one row
    joined = own.crossJoin(F.broadcast(edges))
    below = lambda i, value: F.when(value.isNotNull(), F.size(F.filter(f"_e{i}", lambda e: e < value)))
    return joined.select([below(i, F.col(c)).alias(c) for i, c in enumerate(columns)])


def binned_information(df: DataFrame, columns: list[str], bins: int = 16) -> DataFrame:
    """a, b, n, mi (nats, Miller-Madow corrected, 0 at least), equivalent (the correlation with that information), r, gap.

    All rows count: they are binned, and only bin pairs are shuffled. ``neighbours.mutual_information`` needs no bins.
    """
    b = binned(df, columns, bins)
    pairs = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).alias("x"), F.col(y).alias("y")) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    cells = b.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").alias("m"))
    own = Window.partitionBy("a", "b")
    joint = cells.withColumns({"n": F.sum("m").over(own), "mx": F.sum("m").over(Window.partitionBy("a", "b", "x")), "my": F.sum("m").over(Window.partitionBy("a", "b", "y"))})
    m = joint.groupBy("a", "b", "n").agg(
        F.sum(F.col("m") / F.col("n") * F.log(F.col("m") * F.col("n") / (F.col("mx") * F.col("my")))).alias("raw"), F.count("*").alias("k"), F.count_distinct("x").alias("kx"), F.count_distinct("y").alias("ky"),
    ).where(F.col("n") >= LEAST_ROWS)
    mi = F.greatest(F.lit(0.0), F.col("raw") - (F.col("k") - F.col("kx") - F.col("ky") + 1) / (2 * F.col("n")))
    r = pearson_pairs(df, columns).select("a", "b", "r")
    equal = F.sqrt(1 - F.exp(-2 * F.col("mi")))
    found = m.select("a", "b", "n", mi.alias("mi")).join(r, ["a", "b"]).withColumn("equivalent", equal)
    return found.withColumn("gap", F.col("equivalent") - F.abs("r"))


def nonlinear_finds(mi: DataFrame) -> DataFrame:
    return mi.where((F.col("equivalent") >= STRONG_MI) & (F.abs("r") < REDUNDANT) & (F.col("gap") > STRONG_GAP))


def _features(columns: list[str]) -> Pipeline:
    names = [f"_{c}" for c in columns]
    return Pipeline(stages=[Imputer(inputCols=columns, outputCols=names, strategy="median"), VectorAssembler(inputCols=names, outputCol="features")])


def _numbers(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return clean_numbers(df).select(key, *[F.col(c).cast("double").alias(c) for c in columns])


def clusters(df: DataFrame, key: str, columns: list[str], most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rows (key, cluster) and one row per number of clusters (k, silhouette, chosen): k-means on standardised, reduced numbers."""
    spark, data = df.sparkSession, _numbers(df, key, columns)
    n = data.count()
    empty = spark.createDataFrame([], "k int, silhouette double, chosen boolean")
    if n < LEAST_ROWS or len(columns) < 3:
        return data.select(key, F.lit(None).cast("int").alias("cluster")), empty
    steps = [*_features(columns).getStages(), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), PCA(k=min(10, len(columns)), inputCol="scaled", outputCol="reduced")]
    reduced = Pipeline(stages=steps).fit(data).transform(data).select(key, "reduced").persist()
    judge = ClusteringEvaluator(featuresCol="reduced")
    tried = []
    for k in range(2, min(most, n // 10) + 1):
        model = KMeans(k=k, seed=SEED, featuresCol="reduced").fit(reduced)
        tried.append((float(judge.evaluate(model.transform(reduced))), -k, model))
    best = max(tried, key=lambda t: t[:2])
    table = spark.createDataFrame([(-k, s, -k == -best[1]) for s, k, _ in tried], empty.schema)
    return best[2].transform(reduced).select(key, F.col("prediction").alias("cluster")), table


def cluster_profile(df: DataFrame, key: str, columns: list[str], assigned: DataFrame, top: int = 5) -> DataFrame:
    """cluster, n, share, traits: the columns whose mean differs most from that of all rows, in standard deviations."""
    whole = describe_numeric(df, columns, exact=False).select("variable", F.col("mean").alias("all_mean"), F.col("sd").alias("all_sd"))
    long = _numbers(df, key, columns).join(assigned, key).unpivot([key, "cluster"], columns, "variable", "value").where("value is not null")
    means = long.groupBy("cluster", "variable").agg(F.avg("value").alias("mean")).join(F.broadcast(whole), "variable")
    z = F.try_divide(F.col("mean") - F.col("all_mean"), F.col("all_sd"))
    order = Window.partitionBy("cluster").orderBy(F.abs("z").desc(), "variable")
    traits = means.withColumn("z", z).where("z is not null").withColumn("i", F.row_number().over(order)).where(F.col("i") <= top)
    traits = traits.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "variable", "z"))).alias("t"))
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    return sizes.join(traits, "cluster", "left").select("cluster", "n", "share", F.transform("t", lambda x: F.struct(x["variable"].alias("variable"), x["z"].alias("z"))).alias("traits"))


def _path(x: np.ndarray, tree: list[tuple]) -> np.ndarray:
    at, depth = np.zeros(len(x), int), np.zeros(len(x))
    column, cut, left, right, rest = (np.array(v) for v in zip(*tree, strict=True))
    while (inner := column[at] >= 0).any():
        go = np.flatnonzero(inner)
        node = at[go]
        at[go] = np.where(x[go, column[node]] < cut[node], left[node], right[node])
        depth[go] += 1
    return depth + rest[at]


def _spare(n: int) -> float:
    """The expected depth that a leaf of n rows still hides."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[tuple] = []

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, -1, -1, _spare(len(rows))))
        varied = np.flatnonzero(rows.min(0) < rows.max(0)) if len(rows) > 1 else []
        if depth < limit and len(varied):
            c = int(rng.choice(varied))
            cut = float(rng.uniform(rows[:, c].min(), rows[:, c].max()))
            below = rows[:, c] < cut
            if below.any() and not below.all():
                left = add(rows[below], depth + 1)
                nodes[me] = (c, cut, left, add(rows[~below], depth + 1), 0.0)
        return me

    add(x, 0)
    return nodes


def anomalies(df: DataFrame, key: str, columns: list[str], trees: int = TREES, rows: int = TREE_ROWS) -> DataFrame:
    """key, score (isolation forest, 0 to 1) and the row's numbers as z values, for every row.

    The forest is fitted, as isolation forests are, on a documented bounded sample: ``rows`` rows for each of ``trees`` trees, those with the
    smallest hashes. Every row is scored.
    """
    data = _numbers(df, key, columns)
    stats = {r["variable"]: r for r in describe_numeric(df, columns, exact=False).collect()}  # a row per column
    columns = [c for c in columns if c in stats and stats[c]["sd"] > 0]
    z = [F.coalesce((F.col(c) - stats[c]["mean"]) / stats[c]["sd"], F.lit((stats[c]["median"] - stats[c]["mean"]) / stats[c]["sd"])).alias(c) for c in columns]
    scaled = data.select(key, *z)
    sample = scaled.orderBy(F.xxhash64(key, F.lit(SEED)), key).limit(trees * rows).drop(key).toPandas().to_numpy(float)
    order = np.random.default_rng(SEED)
    size = min(rows, len(sample))
    forest = [_grow(sample[order.choice(len(sample), size, replace=False)], order, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees if len(sample) >= LEAST_ROWS else 0)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[columns].to_numpy(float)
            depth = np.mean([_path(x, t) for t in forest], 0) if forest else np.zeros(len(x))
            yield b.assign(score=2.0 ** (-depth / _spare(size)) if forest else np.nan)

    types = dict(scaled.dtypes)
    return scaled.mapInPandas(work, ", ".join(f"`{c}` {types[c]}" for c in scaled.columns) + ", score double")


def top_anomalies(scored: DataFrame, key: str, columns: list[str], most: int = TOP_ANOMALIES, reasons: int = TOP_REASONS) -> DataFrame:
    """The rows with the highest scores and the columns that stand out in them; a report of ``most`` rows."""
    found = F.array_sort(F.array(*[F.struct((-F.abs(F.col(c))).alias("far"), F.lit(c).alias("variable"), F.col(c).alias("z")) for c in columns if c in scored.columns]))
    top = scored.orderBy(F.col("score").desc(), key).limit(most)
    return top.select(key, "score", F.transform(F.slice(found, 1, reasons), lambda x: F.struct(x["variable"].alias("variable"), x["z"].alias("z"))).alias("reasons"))
