"""Savitzky-Golay smoothing as a window expression: constant weights, chosen by a row's distance from the ends of its series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def fit_weights(window: int, degree: int) -> np.ndarray:
    """Row r: the weights by which a polynomial fitted to `window` neighbours is evaluated at the r-th of them."""
    v = np.vander(np.arange(window) - window // 2, degree + 1, increasing=True).astype(float)
    return v @ np.linalg.inv(v.T @ v) @ v.T


def smoothed(value: Column, position: Column, n: Column, by: WindowSpec, window: int, degree: int) -> Column:
    """value smoothed over `by`, a clip in order; the first and last half windows take the fit of the first and last full one.

    Series with fewer rows than the window stay as they are.
    """
    if window % 2 == 0 or degree >= window:
        raise ValueError("the window must be odd and larger than the degree")
    weights, half = fit_weights(window, degree), window // 2

    def row(r: int) -> Column:
        total = None
        for j, w in enumerate(weights[r]):
            term = (F.lead(value, j - r) if j > r else F.lag(value, r - j) if j < r else value)
            term = (term.over(by) if j != r else term) * float(w)
            total = term if total is None else total + term
        return total

    out = F.when(n < window, value)
    for r in range(half):
        out = out.when(position == r, row(r)).when(position == n - 1 - r, row(window - 1 - r))
    return out.otherwise(row(half))
