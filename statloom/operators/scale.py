"""Scale reliability and factors of item groups, from one covariance matrix per group."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, f_quantile
from .moments import covariance


#: Fixed pattern of the number that ends an item's name.
ITEM_NUMBER = r"[\s_\-.]*\d+$"


def item_groups(columns: list[str]) -> dict[str, list[str]]:
    """Columns that share a name before trailing digits, three at least."""
    found: dict[str, list[str]] = {}
    for c in columns:
        if (stem := re.sub(ITEM_NUMBER, "", c)) != c:
            found.setdefault(stem, []).append(c)
    return {k: v for k, v in found.items() if len(v) >= 3}


def alpha(cov: np.ndarray) -> float:
    k, total = len(cov), cov.sum()
    return float("nan") if total <= 0 else float(k / (k - 1) * (1 - np.trace(cov) / total))


def _standardised(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd)


def omega(cov: np.ndarray) -> float:
    values, vectors = np.linalg.eigh(_standardised(cov))
    load = vectors[:, -1] * np.sqrt(values[-1])
    load = load * (1 if load.sum() >= 0 else -1)
    return float(load.sum() ** 2 / (load.sum() ** 2 + (1 - load**2).sum()))


def reliability(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """name, k, n, alpha, ci_low, ci_high (Feldt), omega, split_half, spearman_brown."""
    rows = []
    for name, items in groups.items():
        n, _, cov = covariance(df, items)
        k = len(items)
        if n < 10 or k < 3 or (np.diag(cov) <= 0).any():
            continue
        a = alpha(cov)
        low, high = (float(1 - (1 - a) * f_quantile(np.array([p]), n - 1, (n - 1) * (k - 1))[0]) for p in (0.025, 0.975))
        even, odd = slice(0, None, 2), slice(1, None, 2)
        r = float(cov[even, odd].sum() / np.sqrt(cov[even, even].sum() * cov[odd, odd].sum()))
        rows.append((name, k, n, a, low, high, omega(cov), r, 2 * r / (1 + r)))
    return df.sparkSession.createDataFrame(rows, "name string, k long, n long, alpha double, ci_low double, ci_high double, omega double, split_half double, spearman_brown double")


def item_analysis(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """name, item, mean, sd, item_total_r (corrected), alpha_if_deleted, rises."""
    rows = []
    for name, items in groups.items():
        n, mean, cov = covariance(df, items)
        if n < 10 or len(items) < 3 or (np.diag(cov) <= 0).any():
            continue
        a = alpha(cov)
        for i, item in enumerate(items):
            rest = np.delete(np.arange(len(items)), i)
            left = cov[np.ix_(rest, rest)]
            r = float(cov[i, rest].sum() / np.sqrt(cov[i, i] * left.sum()))
            without = alpha(left)
            rows.append((name, item, float(mean[i]), float(np.sqrt(cov[i, i])), r, without, bool(without > a)))
    return df.sparkSession.createDataFrame(rows, "name string, item string, mean double, sd double, item_total_r double, alpha_if_deleted double, rises boolean")


def adequacy(r: np.ndarray, n: int) -> tuple[float, float, int, float]:
    """KMO, and Bartlett's statistic, df and p."""
    inverse = np.linalg.pinv(r)
    partial = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(len(r), dtype=bool)
    kmo = float((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum()))
    sign, log = np.linalg.slogdet(r)
    k = len(r)
    df = k * (k - 1) // 2
    stat = float(-(n - 1 - (2 * k + 5) / 6) * log) if sign > 0 else float("nan")
    return kmo, stat, df, float(chi2_sf(stat, df)) if sign > 0 else float("nan")


def varimax(loadings: np.ndarray, rounds: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    turn, before = np.eye(loadings.shape[1]), 0.0
    for _ in range(rounds):
        x = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (x**3 - x @ np.diag((x**2).mean(0))))
        turn = u @ v
        if s.sum() < before * (1 + tolerance):
            break
        before = s.sum()
    return loadings @ turn


def factors(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """name, item, factor loadings as an array, dominant factor, communality, kmo, bartlett, bartlett_p, explained."""
    schema = "name string, item string, loadings array<double>, dominant int, communality double, kmo double, bartlett double, bartlett_p double, explained double"
    n, _, cov = covariance(df, columns)
    k = len(columns)
    if k < 4 or n < max(20, 3 * k) or (np.diag(cov) <= 0).any():
        return df.sparkSession.createDataFrame([], schema)
    r = _standardised(cov)
    values, vectors = np.linalg.eigh(r)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = int(min(max(1, (values > 1).sum()), k - 1))
    load = vectors[:, :m] * np.sqrt(values[:m])
    load = varimax(load) if m > 1 else load
    load = load * np.where(load.sum(0) < 0, -1, 1)
    kmo, stat, _, p = adequacy(r, n)
    rows = [(name, c, [float(x) for x in load[i]], int(np.abs(load[i]).argmax()) + 1, float((load[i] ** 2).sum()), kmo, stat, p, float(values[:m].sum() / k)) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, schema)


def label_alpha(a: Column) -> Column:
    return F.when(a.isNull() | F.isnan(a), "").when(a < 0.5, "unacceptable").when(a < 0.6, "poor").when(a < 0.7, "questionable").when(a < 0.8, "acceptable").when(a < 0.9, "good").otherwise("excellent")


def label_kmo(k: Column) -> Column:
    return F.when(k.isNull() | F.isnan(k), "").when(k < 0.5, "unacceptable").when(k < 0.6, "poor").when(k < 0.7, "mediocre").when(k < 0.8, "middling").when(k < 0.9, "good").otherwise("excellent")
