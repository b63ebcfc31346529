"""Natural cubic splines with linear tails, on the driver and as Catalyst expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def slopes(knots: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the natural interpolant; zero at both ends. Heights may be a matrix."""
    n, h = len(knots), np.diff(knots)
    out = np.zeros_like(heights, float)
    if n > 2:
        a = np.diag((h[:-1] + h[1:]) / 3) + np.diag(h[1:-1] / 6, 1) + np.diag(h[1:-1] / 6, -1)
        rise = np.diff(heights, axis=0) / (h[:, None] if heights.ndim > 1 else h)
        out[1:-1] = np.linalg.solve(a, np.diff(rise, axis=0))
    return out


def coefficients(knots: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Rows (c0, c1, c2, c3) in x - knot for the left tail, each interval and the right tail."""
    m, h = slopes(knots, heights), np.diff(knots)
    rise = np.diff(heights) / h
    body = np.stack([heights[:-1], rise - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m) / (6 * h)], 1)
    left = [heights[0], body[0, 1], 0, 0]
    right = [heights[-1], rise[-1] + h[-1] * (m[-2] + 2 * m[-1]) / 6, 0, 0]
    return np.vstack([left, body, right])


def evaluate(knots: np.ndarray, heights: np.ndarray, x: np.ndarray) -> np.ndarray:
    c = coefficients(knots, heights)
    i = np.searchsorted(knots, x, "right")
    d = x - knots[np.clip(i - 1, 0, None)]
    return ((c[i, 3] * d + c[i, 2]) * d + c[i, 1]) * d + c[i, 0]


def basis(knots: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Column j is the spline that is 1 at knot j and 0 at the others."""
    return np.stack([evaluate(knots, row, x) for row in np.eye(len(knots))], 1)


def curvature(knots: np.ndarray) -> np.ndarray:
    """Matrix K with heights' K heights the integral of the squared second derivative."""
    m = slopes(knots, np.eye(len(knots)))
    h = np.diff(knots)
    a, b = m[:-1], m[1:]
    return (np.einsum("i,ij,ik->jk", h / 3, a, a) + np.einsum("i,ij,ik->jk", h / 3, b, b) + np.einsum("i,ij,ik->jk", h / 6, a, b) + np.einsum("i,ij,ik->jk", h / 6, b, a))


def expression(x: Column, knots: np.ndarray, heights: np.ndarray) -> Column:
    """The spline at a column, null where it is null, NaN or infinite."""
    c = coefficients(knots, heights)

    def leaf(i: int) -> Column:
        d = x - F.lit(float(knots[max(i - 1, 0)]))
        c0, c1, c2, c3 = (float(v) for v in c[i])
        return F.lit(c0) + d * c1 if c2 == c3 == 0 else ((d * c3 + c2) * d + c1) * d + c0

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(x < float(knots[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), tree(0, len(knots)))
