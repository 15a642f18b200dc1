"""Natural cubic splines as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.functions.expr import sum_of


def _curvatures(knots: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the splines that are 1 at one knot and 0 at the others."""
    k = len(knots)
    h = np.diff(knots)
    left, right = np.zeros((k, k)), np.zeros((k, k))
    left[0, 0] = left[-1, -1] = 1.0
    for i in range(1, k - 1):
        left[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    return np.linalg.solve(left, right)


def _pieces(knots: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted knots, cubic coefficients ``[interval, basis, power]`` and the slopes before the first and after the last knot."""
    t = np.asarray(sorted(float(k) for k in knots))
    m = _curvatures(t)
    h = np.diff(t)
    y = np.eye(len(t))
    cubic = np.zeros((len(h), len(t), 4))
    for i in range(len(h)):
        cubic[i, :, 0] = y[i]
        cubic[i, :, 1] = (y[i + 1] - y[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6
        cubic[i, :, 2] = m[i] / 2
        cubic[i, :, 3] = (m[i + 1] - m[i]) / (6 * h[i])
    before = (y[1] - y[0]) / h[0] - h[0] * m[1] / 6
    after = (y[-1] - y[-2]) / h[-1] + h[-1] * m[-2] / 6
    return t, cubic, before, after


def natural_spline(col: str | Column, knots: Sequence[float]) -> list[Column]:
    """Basis columns of a natural cubic spline in its knot-value form.

    Column ``j`` is the spline through 1 at knot ``j`` and 0 at all others, so a
    coefficient is the effect at its knot relative to the first knot, which has
    no column. Beyond the outer knots the basis goes on as a straight line.
    """
    x = F.col(col) if isinstance(col, str) else col
    x = x.cast("double")
    t, cubic, before, after = _pieces(knots)
    basis = []
    for j in range(1, len(t)):
        out = F.when(x < t[0], F.lit(float(cubic[0, j, 0])) + F.lit(float(before[j])) * (x - t[0]))
        for i in range(len(cubic)):
            u = x - float(t[i])
            c0, c1, c2, c3 = (F.lit(float(c)) for c in cubic[i, j])
            out = out.when(x <= float(t[i + 1]), c0 + u * (c1 + u * (c2 + u * c3)))
        basis.append(out.otherwise(F.lit(1.0 if j == len(t) - 1 else 0.0) + F.lit(float(after[j])) * (x - float(t[-1]))))
    return basis


def spline_values(x: np.ndarray, knots: Sequence[float]) -> np.ndarray:
    """The columns of ``natural_spline`` for numbers: one row per element of ``x``."""
    x = np.asarray(x, dtype=float)
    t, cubic, before, after = _pieces(knots)
    at = np.clip(np.searchsorted(t, x, side="left") - 1, 0, len(cubic) - 1)
    u = (x - t[at])[:, None]
    c = cubic[at]
    out = c[:, :, 0] + u * (c[:, :, 1] + u * (c[:, :, 2] + u * c[:, :, 3]))
    ends = np.eye(len(t))
    low, high = x < t[0], x > t[-1]
    out[low] = ends[0] + (x[low] - t[0])[:, None] * before
    out[high] = ends[-1] + (x[high] - t[-1])[:, None] * after
    return out[:, 1:]


def quantile_knots(df: DataFrame, col: str, df_spline: int) -> list[float]:
    """Boundary knots at the data's edges, interior knots at even quantiles: ``df_spline + 1`` in all.

    The column has few distinct values (an interval number), so it is counted first.
    """
    from spellwise.operators.describe import exact_quantiles

    probs = [i / df_spline for i in range(df_spline + 1)]
    one = df.select(F.lit(0).alias("__g"), F.col(col).cast("double").alias("v"))
    rows = exact_quantiles(one, "v", probs, ["__g"], cell_width=1.0).orderBy("prob").collect()
    return sorted({r["value"] for r in rows})


__all__ = ["natural_spline", "quantile_knots", "spline_values", "sum_of"]
