"""Corrections for multiple testing over tables of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.05


def adjust_p(tests: DataFrame, p: str = "p", family: list[str] | None = None, alpha: float = ALPHA) -> DataFrame:
    """Add p_bonferroni, p_holm, p_bh and significant_bh within each family; a null p stays null and isn't counted."""
    own = [*(family or []), F.col(p).isNull()]
    m = F.count(p).over(Window.partitionBy(*own))
    i = F.row_number().over(Window.partitionBy(*own).orderBy(p))
    step = tests.withColumns({"_m": m, "_i": i})
    up = Window.partitionBy(*own).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*own).orderBy("_i").rowsBetween(0, Window.unboundedFollowing)
    known = F.col(p).isNotNull()
    out = step.withColumns({
        "p_bonferroni": F.when(known, F.least(F.lit(1.0), F.col(p) * F.col("_m"))),
        "p_holm": F.when(known, F.max(F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_i") + 1))).over(up)),
        "p_bh": F.when(known, F.min(F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_i"))).over(down)),
    })
    return out.withColumn("significant_bh", F.when(known, F.col("p_bh") < alpha)).drop("_m", "_i")


def family_adjust(findings: DataFrame, method: str = "holm", p: str = "p", family: str = "family") -> DataFrame:
    """p_adjusted within families of two tests or more; other families and method 'none' keep p."""
    if method not in ("none", "holm", "fdr_bh"):
        raise ValueError(f"unknown method {method}")
    if method == "none":
        return findings.withColumn("p_adjusted", F.col(p))
    done = adjust_p(findings, p, [family])
    size = F.count(p).over(Window.partitionBy(family))
    chosen = F.col("p_holm" if method == "holm" else "p_bh")
    return done.withColumn("p_adjusted", F.when(size >= 2, chosen).otherwise(F.col(p))).drop("p_bonferroni", "p_holm", "p_bh", "significant_bh")
