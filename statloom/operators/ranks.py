"""Mid-ranks, exact quantiles and concordance without a single-task sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def mid_ranks(cells: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS, weight: str | None = None) -> DataFrame:
    """keys, value, n (rows with that value), rank (their mid-rank within the keys), total (rows of the keys).

    Rows are first counted per value. Approximate quantiles cut each key's range into buckets; a running sum within a
    bucket starts from the rows in the buckets before it, so the ranks are exact whatever the cuts. With ``weight``, a row
    stands for that many.
    """
    counted = cells.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)]).alias("_cuts"))
    # a row per key (a variable or a pair of them): as small as the plan of tests
    placed = counted.join(F.broadcast(cuts), keys) if keys else counted.crossJoin(F.broadcast(cuts))
    placed = placed.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), F.sum("_rows").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(offsets), [*keys, "_bucket"])
    rank = F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2
    return ranked.select(*keys, value, "n", rank.cast("double").alias("rank"), "total")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """keys and q, an array of exact quantiles (linear between neighbours), from ranks of counted values: no task holds a whole key. With ``weight``, a row stands for that many."""
    ranked = mid_ranks(rows, keys, value, weight=weight)
    half = (F.col("n") - 1) / 2
    found = []
    for share in shares:
        place = (F.col("total") - 1) * share + 1
        at = lambda p: F.max(F.when(p.between(F.col("rank") - half, F.col("rank") + half), F.col(value)))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        found.append(low + part * (high - low))
    return ranked.groupBy(*keys).agg(F.array(*found).alias("q"))


def _signed(table: pa.Table) -> pa.Table:
    """One row s: the sum of n_a * n_b * sign(y_b - y_a) over pairs with x_a < x_b, by merging halves of doubling blocks."""
    x, y = (np.unique(table.column(c).to_numpy(), return_inverse=True)[1].astype(np.int64) for c in ("x", "y"))
    n = table.column("n").to_numpy().astype(np.float64)

    def ascents(y: np.ndarray) -> float:
        order = np.lexsort((-y, x))  # equal x: larger y first, so that they are never an ascent
        rank, weight = y[order] - y.min(), n[order]
        place, values = np.arange(len(order)), int(rank.max()) + 1
        total, width = 0.0, 1
        while width < len(order):
            block, right = place // (2 * width), place // width % 2
            by = np.argsort((block * values + rank) * 2 + 1 - right)
            later = right[by] == 1
            before = np.cumsum(np.where(later, 0.0, weight[by]))
            whole = np.concatenate([[0.0], np.cumsum(np.bincount(block, weight * (right == 0)))])[block[by]]
            total += float(((before - whole) * weight[by])[later].sum())
            width *= 2
        return total

    return pa.table({"s": [ascents(y) - ascents(-y)]})


def concordance(df: DataFrame, x: str, y: str, buckets: int = BUCKETS) -> DataFrame:
    """One row: n, s (concordant minus discordant pairs), and for x and y the tie sums of Kendall's tau: t of m(m-1)/2, u of m(m-1)(m-2),
    v of m(m-1)(2m+5) over the m rows of each value. Nulls and NaN are left out; without rows n is null and s is 0.

    Rows are counted per cell of equal (x, y), and approximate quantiles of the cells cut x and y into buckets; a cut itself is a bucket of
    its own, so a value that many cells share meets nobody. A pair of cells lies in one bucket of x, or else in one of y, or in two
    of both: the first two are counted inside the buckets, the last over the grid of buckets. Tasks hold a bucket or the grid, of
    at most (2 * buckets)^2 rows, never all cells; the result doesn't depend on the cuts.
    """
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    cells = known.groupBy("x", "y").agg(F.count("*").alias("n"))
    shares = [i / buckets for i in range(1, buckets)]
    # one row of at most ``buckets`` numbers for x and for y
    cuts = cells.agg(*[F.percentile_approx(c, shares).alias(f"cuts_{c}") for c in ("x", "y")])
    bucket = lambda c: (2 * F.size(F.filter(f"cuts_{c}", lambda cut: cut < F.col(c))) + F.array_contains(f"cuts_{c}", F.col(c)).cast("int")).alias(f"b{c}")
    placed = cells.crossJoin(F.broadcast(cuts)).select("x", "y", "n", bucket("x"), bucket("y"))
    # an odd bucket is a single value
    inside_x = placed.where("bx % 2 = 0").select(F.lit(0).alias("kind"), F.col("bx").alias("bucket"), "x", "y", "n")
    inside_y = placed.where("by % 2 = 0").groupBy("by", "bx", "y").agg(F.sum("n").alias("n")).select(F.lit(1).alias("kind"), F.col("by").alias("bucket"), F.col("bx").cast("double").alias("x"), "y", "n")
    grid = placed.groupBy("bx", "by").agg(F.sum("n").alias("n")).select(F.lit(2).alias("kind"), F.lit(0).alias("bucket"), F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y"), "n")
    s = inside_x.unionByName(inside_y).unionByName(grid).groupBy("kind", "bucket").applyInArrow(_signed, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    m = F.col("m").cast("double")

    def ties(c: str) -> DataFrame:
        return cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(m * (m - 1) / 2).alias(f"t{c}"), F.sum(m * (m - 1) * (m - 2)).alias(f"u{c}"), F.sum(m * (m - 1) * (2 * m + 5)).alias(f"v{c}"))

    # single rows
    return cells.agg(F.sum("n").alias("n")).crossJoin(s).crossJoin(ties("x")).crossJoin(ties("y"))
