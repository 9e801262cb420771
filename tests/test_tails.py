"""Tails of distributions against closed forms and expansions, up to very large degrees of freedom."""

import math

import numpy as np
import pytest

from statloom.functions.special import chi2_sf, f_sf, t_quantile, t_sf2


@pytest.mark.parametrize("df", [1e5, 1e6, 1e7, 1e9])
def test_large_degrees_of_freedom(df):
    # P(X > df) of chi-square, by its expansion about the mean
    assert math.isclose(float(chi2_sf(df, df)), 0.5 - 1 / (3 * math.sqrt(math.pi * df)), abs_tol=1e-8)
    assert math.isclose(float(f_sf(1.0, df, df)), 0.5, abs_tol=1e-8)
    z = 1.959963984540054  # t exceeds the normal's quantile a little more often: the first term of the expansion
    excess = 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (z + z**3) / (4 * df)
    assert math.isclose(float(t_sf2(z, df)), 0.05 + excess, abs_tol=1e-8)  # what the module promises


def test_closed_forms():
    x = np.array([0.1, 1.0, 7.5, 60.0])
    assert np.allclose(chi2_sf(x, 2), np.exp(-x / 2), rtol=1e-10)
    assert np.allclose(f_sf(x, 2, 8), (1 + 2 * x / 8) ** -4, rtol=1e-10)
    assert np.allclose(t_sf2(x, 1), 1 - 2 * np.arctan(x) / math.pi, rtol=1e-9)
    assert np.allclose(t_quantile(0.05, [1, 10]), [12.706204736, 2.228138852], rtol=1e-8)
