"""Distributions as arrays: quantile functions and monotone fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import interpolated


def inverse_cdf(u: Column, levels: Column, quantiles: Column) -> Column:
    return interpolated(u, levels, quantiles)


def crps(sample: Column, y: Column) -> Column:
    """Of an ensemble: mean |x - y| - half the mean |x - x'|; sorted, the pairs are one pass."""
    n = F.size(sample)
    ordered = F.array_sort(sample)
    first = F.aggregate(sample, F.lit(0.0), lambda a, x: a + F.abs(x - y)) / n
    spread = F.aggregate(F.transform(ordered, lambda x, i: x * (2 * i + 1 - n)), F.lit(0.0), lambda a, x: a + x) / (n * n)
    return first - spread


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-increasing sequence in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def decreasing(values: Column | str, weights: Column | str) -> Column:
    """``pool_adjacent`` of arrays, such as survival probabilities at rising thresholds."""

    @F.pandas_udf("array<double>")
    def pooled(v: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else pool_adjacent(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(v, w, strict=True)])

    return pooled(values, weights)


def shifted_curve(probabilities: Column | str, thresholds: list[float], delta: Column, falling: bool = True) -> Column:
    """Probabilities at fixed rising thresholds (two or more) of a curve that moves by delta: P(X + delta >= t) from P(X >= t).

    Linear between thresholds, and beyond the outer ones along the outer pieces, in log odds; odds stay within one in a million.  The result
    falls (a survival curve) or rises (a CDF).  A null, of the curve or of its delta, gives null.
    """
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    at = F.array(*[F.lit(float(t)) for t in thresholds])
    clipped = lambda x: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))

    def moved(odds: Column) -> Column:
        values = []
        for t in thresholds:
            x = F.lit(float(t)) - delta
            i = F.lit(0)
            for k in range(1, len(thresholds) - 1):
                i = F.when(x >= thresholds[k], k).otherwise(i)
            slope = (F.get(odds, i + 1) - F.get(odds, i)) / (F.get(at, i + 1) - F.get(at, i))
            values.append(1 / (1 + F.exp(-(F.get(odds, i) + slope * (x - F.get(at, i))))))
        return F.array(*values)

    # odds and shifted values stand in arrays of one element, so that each is computed once
    odds = F.transform(F.array(p), lambda a: F.transform(a, lambda x: F.ln(clipped(x) / (1 - clipped(x)))))
    values = F.transform(odds, moved)
    kept = F.array_min if falling else F.array_max
    out = F.get(F.transform(values, lambda v: F.transform(v, lambda _, j: kept(F.slice(v, F.lit(1), j + 1)))), F.lit(0))
    return F.when(~F.exists(p, lambda x: x.isNull()) & delta.isNotNull(), out)
