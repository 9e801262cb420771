"""The masked Gram pass: moments of every pair of columns under pairwise deletion, in one scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centres(df: DataFrame, columns: list[str]) -> list[float]:
    known = lambda v: F.when(F.abs(v) < float("inf"), v)  # noqa: E731  NaN is missing, and nothing is centred at infinity
    row = df.agg(*[F.avg(known(F.col(c).cast("double"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [float(x or 0.0) for x in row]


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, n, sx, sxx, sxy for all ordered pairs of columns; sx and sxx are those of column i over rows where both are known.

    Values are centred first. Each task adds up matrices of columns x columns; only their entries are shuffled.
    """
    shift = np.array(centres(df, columns))
    d = len(columns)

    def work(batches):
        total = np.zeros((4, d, d))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1) if batch.num_rows else np.zeros((0, d))
            known = np.isfinite(x)
            z = np.where(known, x - shift, 0.0)
            mask = known.astype(float)
            total += np.stack([mask.T @ mask, z.T @ mask, (z * z).T @ mask, z.T @ z])
        at = np.indices((d, d)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), *[pa.array(m.ravel()) for m in total]], names=["i", "j", "n", "sx", "sxx", "sxy"])

    parts = df.select([F.col(c).cast("double") for c in columns]).mapInArrow(work, "i int, j int, n double, sx double, sxx double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")])


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, mean_a, mean_b, var_a, var_b, cov for each pair of columns."""
    g = gram(df, columns)
    names = F.array(*[F.lit(c) for c in columns])
    shift = F.array(*[F.lit(c) for c in centres(df, columns)])
    other = g.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    pairs = g.where("i < j and n > 1").join(other, ["i", "j"])
    n = F.col("n")
    return pairs.select(
        F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), n.cast("long").alias("n"),
        (F.col("sx") / n + F.element_at(shift, F.col("i") + 1)).alias("mean_a"), (F.col("sy") / n + F.element_at(shift, F.col("j") + 1)).alias("mean_b"),
        ((F.col("sxx") - F.col("sx") ** 2 / n) / (n - 1)).alias("var_a"), ((F.col("syy") - F.col("sy") ** 2 / n) / (n - 1)).alias("var_b"),
        ((F.col("sxy") - F.col("sx") * F.col("sy") / n) / (n - 1)).alias("cov"),
    )


def covariance(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariance matrix over complete rows; columns x columns numbers reach the driver."""
    complete = df.select([F.col(c).cast("double") for c in columns]).dropna()
    rows = gram(complete, columns).collect()
    d = len(columns)
    n, s, p = np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))
    for r in rows:
        n[r["i"], r["j"]], s[r["i"], r["j"]], p[r["i"], r["j"]] = r["n"], r["sx"], r["sxy"]
    total = n[0, 0] if d else 0
    if total < 2:
        return int(total), np.zeros(d), np.zeros((d, d))
    first = np.diag(s)
    return int(total), first / total + np.array(centres(complete, columns)), (p - np.outer(first, first) / total) / (total - 1)


def known_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as numbers; NaN is missing."""
    numbers = [F.col(c).cast("double") for c in columns]
    return df.select([F.when(~F.isnan(v), v).alias(c) for v, c in zip(numbers, columns, strict=True)])


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)


def summed(df: DataFrame, work, size: int) -> np.ndarray:
    """The sum of work(x) over all Arrow batches x (rows x columns, NaN where missing); partial sums of a fixed size meet at the driver."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(matrix_of(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    rows = df.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out
