"""Tails and quantiles of the normal, t, F and chi-square distributions, in numpy.

They run over tables with a row per test, through the pandas UDFs at the end, never over data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def norm_sf(z):
    """P(Z > z)."""
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


#: A continued fraction or series ends when it changes by less than this; the number of rounds grows with the root of the parameters.
CLOSE, ROUNDS = 1e-15, 2_000_000


def _stirling_rest(z):
    """log gamma(z) less Stirling's formula, without loss of digits for large z."""
    z = np.asarray(z, float)
    big = np.maximum(z, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / big**2) / big**2) / big**2) / big
    small = np.minimum(z, 16.0)
    return np.where(z >= 16, series, _lgamma(small) - (small - 0.5) * np.log(small) + small - 0.5 * math.log(2 * math.pi))


def _deviance(k, mean):
    """k log(k / mean) + mean - k, without loss of digits where k is near the mean."""
    e = (k - mean) / mean
    near = np.clip(e, -0.02, 0.02)
    series = sum((-1.0) ** j * near**j / (j * (j - 1)) for j in range(2, 14))
    far = np.maximum(e, -1 + 1e-300)
    return mean * np.where(np.abs(e) <= 0.02, series, (1 + far) * np.log1p(far) - far)


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(v := 1 - (a + b) * x / (a + 1)) < tiny, tiny, v)
    h = d.copy()
    for m in range(1, ROUNDS):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where(np.abs(v := 1 + num * d) < tiny, tiny, v)
            c = np.where(np.abs(v := 1 + num / c) < tiny, tiny, v)
            h = h * d * c
        if (np.abs(d * c - 1) < CLOSE).all():
            break
    return h


def betainc(a, b, x, rest=None):
    """The regularised incomplete beta function at x; ``rest`` is 1 - x where that is known better than by subtraction."""
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, 1 - np.asarray(x, float) if rest is None else rest)))
    low_x, low_rest = np.clip(x, 1e-300, 1.0), np.clip(rest, 1e-300, 1.0)
    n = a + b
    front = np.sqrt(a * b / (2 * math.pi * n)) * np.exp(_stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b) - _deviance(a, n * low_x) - _deviance(b, n * low_rest))
    low = low_x < (a + 1) / (n + 2)
    # each place takes the side that converges fast
    p, q, at = np.where(low, a, b), np.where(low, b, a), np.where(low, low_x, low_rest)
    part = front * _beta_fraction(p, q, at) / p
    value = np.where(low, part, 1 - part)
    return np.where(x <= 0, 0.0, np.where(rest <= 0, 1.0, value))


def gammaincc(a, x):
    """The regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    front = np.sqrt(a / (2 * math.pi)) * np.exp(-_stirling_rest(a) - _deviance(a, safe))
    series = safe < a + 1
    term = total = np.where(series, 1 / a, 0.0)
    for n in range(1, ROUNDS):
        term = term * safe / (a + n)
        total = total + term
        if (~series | (term < CLOSE * total)).all():
            break
    b = safe + 1 - a
    c, d = np.full_like(safe, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d
    for n in range(1, ROUNDS):
        an = -n * (n - a)
        b = b + 2
        d = 1 / np.where(np.abs(v := an * d + b) < 1e-300, 1e-300, v)
        c = np.where(np.abs(v := b + an / c) < 1e-300, 1e-300, v)
        h = h * d * c
        if (series | (np.abs(d * c - 1) < CLOSE)).all():
            break
    return np.where(x <= 0, 1.0, np.where(series, 1 - front * total, front * h))


def t_sf2(t, df):
    """Two-sided P(|T| > |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_sf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    f = np.maximum(f, 0)
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def chi2_sf(x, df):
    return gammaincc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def tukey_sf(q, k, df, nodes: int = 64):
    """P(Q > q) of the studentised range of k means, by Gauss-Legendre quadrature over the normal place and the pooled deviation."""
    q, k, df = np.broadcast_arrays(*(np.asarray(v, float) for v in (q, k, df)))
    x, w = np.polynomial.legendre.leggauss(nodes)
    place, mass = 8 * x, 8 * w * np.exp(-32 * x * x) / math.sqrt(2 * math.pi)
    upper = norm_sf(-place)
    out = np.empty(q.shape)
    for i, (one, many, free) in enumerate(zip(q.ravel(), k.ravel(), df.ravel(), strict=True)):
        reach = 8 / math.sqrt(2 * free)
        low, high = max(0.0, 1 - reach), 1 + reach
        s = (high + low) / 2 + (high - low) / 2 * x
        density = (high - low) / 2 * w * np.exp(math.log(2) + free / 2 * math.log(free / 2) - math.lgamma(free / 2) + (free - 1) * np.log(s) - free * s * s / 2)
        span = np.maximum(upper[None, :] - norm_sf(one * s[:, None] - place[None, :]), 0)
        out.flat[i] = 1 - (density * (many * (mass * span ** (many - 1)).sum(1))).sum()
    return np.clip(out, 0, 1)


def mann_whitney_exact(n1: int, n2: int, u: float) -> float:
    """Two-sided p of U without ties, by counting arrangements."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1
    for i in range(1, n1 + 1):
        # multiply by (1 - t^(n2 + i)) and divide by (1 - t^i)
        step = n2 + i
        if step <= n1 * n2:
            ways[step:] -= ways[:-step].copy()
        for start in range(i):
            ways[start::i] = np.cumsum(ways[start::i])
    return float(min(1.0, 2 * ways[: int(min(u, n1 * n2 - u)) + 1].sum() / ways.sum()))


def wilcoxon_exact(n: int, w: float) -> float:
    """Two-sided p of the smaller rank sum without ties, by counting subsets of 1 to n."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for i in range(1, n + 1):
        ways[i:] += ways[:-i].copy()
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / ways.sum()))


def _inverse(upper_tail, p, low: float, high: float):
    low, high = np.full_like(p, low), np.full_like(p, high)
    for _ in range(80):
        mid = (low + high) / 2
        above = upper_tail(mid) > p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def t_quantile(p_two_sided, df):
    """t with P(|T| > t) = p."""
    p, df = np.broadcast_arrays(np.asarray(p_two_sided, float), np.asarray(df, float))
    return _inverse(lambda t: t_sf2(t, df), p, 0.0, 1e6)


def f_quantile(p_upper, d1, d2):
    p = np.asarray(p_upper, float)
    return _inverse(lambda f: f_sf(f, d1, d2), p, 0.0, 1e6)


def norm_quantile(p):
    """z with P(Z < z) = p."""
    return _inverse(norm_sf, 1 - np.asarray(p, float), -40.0, 40.0)


def _udf(work, n: int):
    def masked(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns])
        ok = np.isfinite(x).all(0)
        out = np.full(x.shape[1], np.nan)
        if ok.any():
            out[ok] = work(*x[:, ok])
        return pd.Series(out).replace({np.nan: None}).astype(float)

    one = lambda a: masked(a)
    two = lambda a, b: masked(a, b)
    three = lambda a, b, c: masked(a, b, c)
    work_of = (one, two, three)[n - 1]
    for name in ("a", "b", "c")[:n]:
        work_of.__annotations__[name] = pd.Series
    work_of.__annotations__["return"] = pd.Series
    return F.pandas_udf(work_of, "double")


def p_t(t, df):
    """Two-sided p of a t statistic, for columns."""
    return F.nanvl(_udf(t_sf2, 2)(t, df), F.lit(None).cast("double"))


def p_f(f, d1, d2):
    return F.nanvl(_udf(f_sf, 3)(f, d1, d2), F.lit(None).cast("double"))


def p_chi2(x, df):
    return F.nanvl(_udf(chi2_sf, 2)(x, df), F.lit(None).cast("double"))


def p_z(z):
    """Two-sided p of a normal statistic."""
    return F.nanvl(_udf(lambda v: 2 * norm_sf(np.abs(v)), 1)(z), F.lit(None).cast("double"))


def t_critical(df, alpha: float = 0.05):
    return F.nanvl(_udf(lambda d: t_quantile(np.full_like(d, alpha), d), 1)(df), F.lit(None).cast("double"))


def p_tukey(q, k, df):
    return F.nanvl(_udf(tukey_sf, 3)(q, k, df), F.lit(None).cast("double"))


def p_mann_whitney_exact(n1, n2, u):
    work = np.vectorize(lambda a, b, c: mann_whitney_exact(int(a), int(b), c), otypes=[float])
    return F.nanvl(_udf(work, 3)(n1, n2, u), F.lit(None).cast("double"))


def p_wilcoxon_exact(n, w):
    return F.nanvl(_udf(np.vectorize(lambda a, b: wilcoxon_exact(int(a), b), otypes=[float]), 2)(n, w), F.lit(None).cast("double"))
