"""The scan for curved relations: seven models per pair and direction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import f_sf
from .adjust import adjust_p
from .moments import known_numbers, matrix_of, summed

MODELS = ["linear", "quadratic", "cubic", "logarithmic", "exponential", "power", "inverse"]
GAIN, LEAST = 0.05, 0.20


def _pair_moments(known: DataFrame, at: list[tuple[int, int]]) -> dict[int, dict]:
    """n, mx, sx, sst, lx, ly and zeros of each pair (positions of x and y) over the rows that have both; pairs of under 20 rows or
    without variation are left out. Sums are taken of values that each column's mean and deviation centre, so nothing cancels."""
    c = known.agg(*[f(F.col(x)) for x in known.columns for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([v or 0.0 for v in c[0::2]])
    sd = np.array([v or 1.0 for v in c[1::2]])
    names = ["n", "zeros", "x1", "x2", "y1", "y2", "lx", "hx", "ly", "hy"]

    def run(batches):
        sums, low, high = np.zeros((len(at), 6)), np.full((len(at), 2), np.inf), np.full((len(at), 2), -np.inf)
        for batch in batches:
            d = matrix_of(batch)
            z, there = (d - mean) / sd, ~np.isnan(d)
            for k, (i, j) in enumerate(at):
                both = there[:, i] & there[:, j]
                if both.any():
                    u, v, raw = z[both, i], z[both, j], d[both][:, [i, j]]
                    sums[k] += [len(u), (raw[:, 0] == 0).sum(), u.sum(), u @ u, v.sum(), v @ v]
                    low[k], high[k] = np.minimum(low[k], raw.min(0)), np.maximum(high[k], raw.max(0))
        parts = [*sums.T, low[:, 0], high[:, 0], low[:, 1], high[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at))), *map(pa.array, parts)], names=["k", *names])

    partial = known.mapInArrow(run, "k long, " + ", ".join(f"{x} double" for x in names)).groupBy("k")
    rows = partial.agg(*[(F.min if x in ("lx", "ly") else F.max if x in ("hx", "hy") else F.sum)(x).alias(x) for x in names]).collect()
    found = {}
    for r in rows:
        n, (i, j) = int(r["n"]), at[r["k"]]
        if n >= 20 and r["lx"] < r["hx"] and r["ly"] < r["hy"]:
            spread = np.sqrt(max(r["x2"] / n - (r["x1"] / n) ** 2, 1e-300))
            found[r["k"]] = {"n": n, "mx": mean[i] + sd[i] * r["x1"] / n, "sx": sd[i] * spread, "sst": sd[j] ** 2 * (r["y2"] - r["y1"] ** 2 / n), "lx": r["lx"], "ly": r["ly"], "zeros": r["zeros"]}
    return found


def _features(x: np.ndarray, m: float, s: float) -> np.ndarray:
    """Columns 1, z, z2, z3, ln x, 1/x; what x doesn't allow is zero."""
    z = (x - m) / s
    with np.errstate(all="ignore"):
        return np.stack([np.ones_like(x), z, z**2, z**3, np.where(x > 0, np.log(np.where(x > 0, x, 1)), 0), np.where(x != 0, 1 / np.where(x != 0, x, 1), 0)], 1)


_PARTS = {"linear": [0, 1], "quadratic": [0, 1, 2], "cubic": [0, 1, 2, 3], "logarithmic": [0, 4], "inverse": [0, 5], "exponential": [0, 1], "power": [0, 4]}


def _apply(name: str, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    y = f[:, _PARTS[name]] @ b
    return np.exp(np.clip(y, -700, 700)) if name in ("exponential", "power") else y


def _raw_scale(name: str, b: np.ndarray, m: float, s: float) -> list[float]:
    """Coefficients on x of those on (x - m) / s; the other features are on the scale of x already."""
    if name not in ("linear", "quadratic", "cubic", "exponential"):
        return [float(v) for v in b]
    total, power = np.zeros(len(b)), np.ones(1)
    for v in b:
        total[: len(power)] += v * power
        power = np.convolve(power, [-m / s, 1 / s])
    return [float(v) for v in total]


def _fits(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple]:
    """(x, y, model, n, coefficients, sse, r2, adj_r2, p) of all pairs: one pass for the moments of all pairs, one for all coefficients and
    one for all residuals on the scale of y."""
    columns = sorted({c for p in pairs for c in p})
    known = known_numbers(df, columns)
    at = [(columns.index(x), columns.index(y)) for x, y in pairs]
    moments = _pair_moments(known, at)
    kept = sorted(moments)
    if not kept:
        return []

    def values(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The features of x and the values of y in the rows that have both."""
        i, j = at[k]
        both = ~np.isnan(d[:, i]) & ~np.isnan(d[:, j])
        return _features(d[both, i], moments[k]["mx"], moments[k]["sx"]), d[both, j]

    def normal(d: np.ndarray) -> np.ndarray:
        parts = []
        for k in kept:
            f, y = values(d, k)
            parts += [(f.T @ f).ravel(), f.T @ y, f.T @ np.log(np.where(y > 0, y, 1))]
        return np.concatenate(parts)

    sums = summed(known, normal, 48 * len(kept)).reshape(len(kept), 48)
    fits = []
    for k, s in zip(kept, sums, strict=True):
        r, ff, fy, fl = moments[k], s[:36].reshape(6, 6), s[36:42], s[42:]
        for m in MODELS:
            if (m in ("logarithmic", "power") and r["lx"] <= 0) or (m in ("exponential", "power") and r["ly"] <= 0) or (m == "inverse" and r["zeros"]):
                continue
            parts = _PARTS[m]
            fits.append((k, m, np.linalg.lstsq(ff[np.ix_(parts, parts)], (fl if m in ("exponential", "power") else fy)[parts], rcond=None)[0]))

    def residuals(d: np.ndarray) -> np.ndarray:
        own = {k: values(d, k) for k in kept}
        return np.array([((own[k][1] - _apply(m, own[k][0], b)) ** 2).sum() for k, m, b in fits])

    rows = []
    for (k, m, b), e in zip(fits, summed(known, residuals, len(fits)), strict=True):
        r, terms = moments[k], len(b) - 1
        n, r2 = r["n"], 1 - e / r["sst"]
        left = n - terms - 1
        p = float(f_sf(r2 / terms / max((1 - r2) / left, 1e-300), terms, left)) if 0 <= r2 < 1 and left > 0 else None
        rows.append((*pairs[k], m, n, _raw_scale(m, b, r["mx"], r["sx"]), float(e), float(r2), float(1 - (1 - r2) * (n - 1) / left), p))
    return rows


def fit_curves(df: DataFrame, x: str, y: str) -> DataFrame:
    """model, n, coefficients, sse, r2, adj_r2, p for each model that the signs of x and y allow."""
    rows = [r[2:] for r in _fits(df, [(x, y)])]
    return df.sparkSession.createDataFrame(rows, "model string, n long, coefficients array<double>, sse double, r2 double, adj_r2 double, p double")


def hidden_formulas(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, model, adj_r2, gain, p with its corrections, hidden: the best model of the better direction of each pair. Four jobs for all pairs."""
    fitted: dict[tuple[str, str], list[tuple]] = {}
    for r in _fits(df, [(a, b) for a in columns for b in columns if a != b]):
        fitted.setdefault(r[:2], []).append(r)
    rows = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            found = []
            for x, y in ((a, b), (b, a)):
                if fits := fitted.get((x, y)):
                    best = max(fits, key=lambda r: r[7])
                    gain = best[7] - next(r[7] for r in fits if r[2] == "linear")
                    found.append((best[7], x, y, best[2], float(gain), best[8]))
            if found:
                adj, x, y, model, gain, p = max(found, key=lambda v: (v[0], v[1]))
                rows.append((x, y, model, float(adj), gain, p, bool(gain >= GAIN and adj >= LEAST)))
    return adjust_p(df.sparkSession.createDataFrame(rows, "x string, y string, model string, adj_r2 double, gain double, p double, hidden boolean"))


def short_number(x: Column) -> Column:
    """Four significant digits without closing zeros."""
    text = F.format_string("%.4g", x)
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "(\\.\\d*?)0+($|e)", "$1$2"), "\\.($|e)", "$1")).otherwise(text)


def equation(y: str, x: str, model: Column, c: Column) -> Column:
    """The fitted curve as text. ``c``: the coefficients on the scale of x, the constant first; those of exponential and power curves on the log scale."""
    term = lambda v, body: F.concat(F.when(v >= 0, " + ").otherwise(" − "), short_number(F.abs(v)), F.lit(f"·{body}"))
    head = F.concat(F.lit(f"{y} = "), short_number(c[0]))
    powers = [term(c[1], x), term(c[2], f"{x}²"), term(c[3], f"{x}³")]
    return (
        F.when(model == "linear", F.concat(head, powers[0])).when(model == "quadratic", F.concat(head, *powers[:2])).when(model == "cubic", F.concat(head, *powers))
        .when(model == "logarithmic", F.concat(head, term(c[1], f"ln({x})"))).when(model == "inverse", F.concat(head, term(c[1], f"(1/{x})")))
        .when(model == "exponential", F.concat(F.lit(f"{y} = "), short_number(F.exp(c[0])), F.lit("·e^("), short_number(c[1]), F.lit(f"·{x})")))
        .when(model == "power", F.concat(F.lit(f"{y} = "), short_number(F.exp(c[0])), F.lit(f"·{x}^"), short_number(c[1])))
    )
