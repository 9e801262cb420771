"""Mutual information of pairs of numbers from nearest neighbours in the plane, exact over all rows.

Each pair's plane is cut into cells of about ``CELL`` points, by quantiles of x and inside each strip by quantiles of y. A task finds the nearest neighbours within a cell; the
distance to the last of them bounds the true one, so a point asks further only those cells that its square reaches, and is done after that. How many points lie nearer
along x or y alone is the difference of two ranks, from counts inside buckets of the values and offsets of the buckets. So no task holds more than a few cells or a bucket.

Values are divided by their standard deviation, and moved by a hash of the row's number times 1e-10 of their size, so that equal values have an order; the estimate is
that of Kraskov, Stögbauer and Grassberger with the maximum norm.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_table
from .correlate import pearson_pairs
from .describe import as_number

#: Fixed numbers of the estimate: neighbours, least rows of a pair.
NEIGHBOURS, LEAST_ROWS = 3, 25
CELL = 1024
#: Points of a cell that are compared with all its points at a time.
AT_ONCE = 512


def digamma(n: Column) -> Column:
    """For whole numbers from 1, to some 1e-13: the asymptotic series, six places further on."""
    x = n.cast("double") + 6
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    return series - sum((1 / (n + k) for k in range(1, 6)), 1 / n.cast("double"))


def _points(df: DataFrame, columns: list[str], jitter: bool) -> DataFrame:
    """a, b, id, x, y: a row for each pair and row that knows both, scaled and in written form."""
    own = df.select([as_number(df, c).cast("double").alias(c) for c in columns])
    own = own.select([F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) for c in columns])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in combinations(columns, 2)]
    rows = own.withColumn("id", F.monotonically_increasing_id()).select("id", F.explode(F.array(*pairs)).alias("p")).select("p.a", "p.b", "id", "p.x", "p.y").where("x is not null and y is not null")
    size = rows.groupBy("a", "b").agg(F.count("*").alias("n"), *[f(v).alias(k + v) for v in ("x", "y") for k, f in (("sd_", F.stddev_pop), ("m_", lambda c: F.avg(F.abs(F.col(c)))))])
    size = size.where((F.col("n") >= LEAST_ROWS) & (F.col("sd_x") > 0) & (F.col("sd_y") > 0))  # a row per pair
    scaled = lambda v, seed: F.col(v) / F.col(f"sd_{v}") + (
        F.lit(1e-10) * F.greatest(F.lit(1.0), F.col(f"m_{v}") / F.col(f"sd_{v}")) * (F.xxhash64("id", F.lit(seed)).cast("double") / F.lit(2.0**62)) if jitter else F.lit(0.0)
    )
    return work_table(rows.join(size, ["a", "b"]).select("a", "b", "id", "n", scaled("x", 1).alias("x"), scaled("y", 2).alias("y")), "points")


def _below(v: str | Column, cuts: str = "cuts") -> Column:
    """How many of the ascending cuts lie below a value: steps of about the root of their number, then one step."""
    v, n = F.col(v) if isinstance(v, str) else v, F.size(cuts)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int")
    coarse = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (n - 1).cast("int")), step), lambda i: F.get(cuts, i))
    first = (F.greatest(F.lit(1), F.size(F.filter(coarse, lambda c: c < v))) - 1) * step
    return first + F.size(F.filter(F.slice(cuts, first + 1, step), lambda c: c < v))


def _placed(points: DataFrame, cell: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points with their strip and cell, the cuts of x of each pair and those of y of each strip."""
    strips = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n") / cell))).cast("int")
    most = points.select(F.max(strips)).first()[0] or 1
    marks = lambda m: F.array(*[F.lit(i / m) for i in range(1, m)]) if m > 1 else F.array(F.lit(0.5))
    # quantiles at most / i: all pairs with the same number of strips share one aggregate
    shape = points.select("a", "b", "n").distinct().withColumn("strips", strips).select("a", "b", "strips")
    # a row per pair, and below one per pair or strip: by key, all points of a pair would meet in one task
    sized = points.join(F.broadcast(shape), ["a", "b"])
    kinds = [r[0] for r in shape.select("strips").distinct().collect()] if most > 1 else []
    none = F.array().cast("array<double>")

    def cuts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
        found = [rows.where(F.col("strips") == m).groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, marks(m), F.lit(10_000)))).alias("cuts") if m > 1 else F.first(none).alias("cuts")) for m in (kinds or [1])]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    x_cuts = work_table(cuts(sized, ["a", "b"], "x"), "cuts")
    striped = sized.join(F.broadcast(x_cuts), ["a", "b"]).withColumn("strip", _below("x")).drop("cuts")
    y_cuts = work_table(cuts(striped, ["a", "b", "strip"], "y"), "cuts")
    placed = striped.join(F.broadcast(y_cuts), ["a", "b", "strip"]).withColumn("cell", _below("y")).drop("cuts", "strips")
    return work_table(placed, "placed"), x_cuts, y_cuts


def _nearest(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, k: int, itself: np.ndarray | None) -> np.ndarray:
    """The k smallest distances of each of some points to others (inf where there are fewer); ``itself``: the place of each among the others."""
    out = np.full((len(px), k), np.inf)
    for at in range(0, len(px), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        d = np.maximum(np.abs(px[part, None] - x), np.abs(py[part, None] - y))
        if itself is not None:
            d[np.arange(len(d)), itself[part]] = np.inf
        m = min(k, d.shape[1])
        out[part, :m] = np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1)
    return out


def neighbour_distances(points: DataFrame, k: int = NEIGHBOURS, cell: int = CELL) -> DataFrame:
    """a, b, id, x, y, n, r: the distance of each point to its k-th nearest neighbour."""
    placed, x_cuts, y_cuts = _placed(points, cell)
    home_schema = "a string, b string, id long, n long, x double, y double, strip int, cell int, near array<double>"

    def at_home(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        near = _nearest(x, y, x, y, k, np.arange(len(x)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k, dtype=np.int32)), pa.array(near.ravel()))
        return table.select(["a", "b", "id", "n", "x", "y", "strip", "cell"]).append_column("near", lists)

    home = work_table(placed.groupBy("a", "b", "strip", "cell").applyInArrow(at_home, home_schema), "home")
    # the cells that the square of a point reaches, but for its own
    r = F.element_at("near", k)
    reach = lambda v: F.sequence(_below(F.col(v) - r), _below(F.col(v) + r))
    asking = home.withColumnRenamed("strip", "own_strip").withColumnRenamed("cell", "own_cell").join(F.broadcast(x_cuts), ["a", "b"])
    asking = asking.withColumn("strip", F.explode(reach("x"))).drop("cuts").join(F.broadcast(y_cuts), ["a", "b", "strip"]).withColumn("cell", F.explode(reach("y"))).drop("cuts")
    asking = asking.where((F.col("strip") != F.col("own_strip")) | (F.col("cell") != F.col("own_cell"))).select("a", "b", "strip", "cell", "id", "x", "y")

    def abroad(own: pa.Table, asked: pa.Table) -> pa.Table:
        if own.num_rows and asked.num_rows:
            near = _nearest(*(own.column(c).to_numpy() for c in "xy"), *(asked.column(c).to_numpy() for c in "xy"), k, None)
        else:
            near = np.full((asked.num_rows, k), np.inf)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k, dtype=np.int32)), pa.array(near.ravel()))
        return asked.select(["a", "b", "id"]).append_column("near", lists)

    keys = ["a", "b", "strip", "cell"]
    more = placed.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(abroad, "a string, b string, id long, near array<double>")
    # a few short lists a point
    merged = home.select("a", "b", "id", "near").unionByName(more).groupBy("a", "b", "id").agg(F.element_at(F.array_sort(F.flatten(F.collect_list("near"))), k).alias("r"))
    return home.select("a", "b", "id", "n", "x", "y").join(merged, ["a", "b", "id"])


def _marginal_counts(found: DataFrame, cell: int) -> DataFrame:
    """a, b, n, axis, own: for each point, how many points (itself included) are nearer than r along one axis."""
    ends = found.select("a", "b", "id", "n", "r", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v")))).alias("e")).select("a", "b", "id", "n", "r", "e.axis", "e.v")
    ends = work_table(ends, "ends")
    # the neighbour that gives r doesn't count: what sums of v and r may be rounded by is taken off r
    near = F.col("r") - (F.abs("v") + F.col("r")) * F.lit(2.0**-50)
    # places: what lies at or below v - r, the values, and what lies below v + r, in the order in which equal places count
    places = ends.select("a", "b", "axis", "id", "n", F.explode(F.array(
        F.struct((F.col("v") - near).alias("at"), F.lit(2).alias("kind")), F.struct(F.col("v").alias("at"), F.lit(1).alias("kind")), F.struct((F.col("v") + near).alias("at"), F.lit(0).alias("kind")),
    )).alias("p")).select("a", "b", "axis", "id", "n", "p.at", "p.kind")
    buckets = max(1, int((ends.groupBy("a", "b", "axis").count().agg(F.max("count")).first()[0] or 1) // (8 * cell)))
    cuts = ends.groupBy("a", "b", "axis").agg(F.array_distinct(F.percentile_approx("v", [i / (buckets + 1) for i in range(1, buckets + 1)], 10_000)).alias("cuts"))
    placed = places.join(F.broadcast(cuts), ["a", "b", "axis"]).withColumn("bucket", _below("at")).drop("cuts")  # a row per pair and axis
    value = (F.col("kind") == 1).cast("long")
    totals = placed.groupBy("a", "b", "axis", "bucket").agg(F.sum(value).alias("m"))
    before = Window.partitionBy("a", "b", "axis").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("a", "b", "axis", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("a", "b", "axis", "bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("so_far", F.sum(value).over(inside)).where("kind <> 1").join(F.broadcast(offsets), ["a", "b", "axis", "bucket"])
    signed = F.when(F.col("kind") == 0, F.col("first") + F.col("so_far")).otherwise(-(F.col("first") + F.col("so_far")))
    return ranked.groupBy("a", "b", "n", "axis", "id").agg(F.greatest(F.sum(signed), F.lit(1)).alias("own"))


def mutual_information(df: DataFrame, columns: list[str], k: int = NEIGHBOURS, cell: int = CELL, jitter: bool = True) -> DataFrame:
    """a, b, n, mi (nats, 0 at least), equivalent (the correlation with that information), r, gap, for every pair with 25 rows that varies.

    Without ``jitter`` equal values stay equal; a point whose k nearest neighbours are all at its own place then counts itself alone along both axes.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, mi double, equivalent double, r double, gap double")
    found = neighbour_distances(_points(df, columns, jitter), k, cell)
    means = _marginal_counts(found, cell).groupBy("a", "b", "n", "axis").agg(F.avg(digamma(F.col("own"))).alias("m")).groupBy("a", "b", "n").agg(F.sum("m").alias("m"))
    mi = F.greatest(F.lit(0.0), digamma(F.col("n")) + digamma(F.lit(k)) - F.col("m"))
    equal = F.sqrt(1 - F.exp(-2 * F.col("mi")))
    r = pearson_pairs(df, columns).select("a", "b", "r")
    return means.select("a", "b", "n", mi.alias("mi")).join(r, ["a", "b"]).withColumn("equivalent", equal).withColumn("gap", F.col("equivalent") - F.abs("r")).select("a", "b", "n", "mi", "equivalent", "r", "gap")
