"""Statistical column expressions, and the Beta quantile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_low(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of Wilson's interval for k (may be fractional) of n; null where n is 0."""
    p = k / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def wilson_high(k: Column, n: Column, z: float = 1.96) -> Column:
    p = k / n
    return F.when(n > 0, (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def wilson_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Both ends within 0 and 1; 0 and 1 where nothing was counted."""
    low, high = wilson_low(k, n, z), wilson_high(k, n, z)
    return F.greatest(F.lit(0.0), F.coalesce(low, F.lit(0.0))), F.least(F.lit(1.0), F.coalesce(high, F.lit(1.0)))


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    return (gamma(a) + gamma(b) - gamma(a + b)).astype(float)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz); ``scale`` is log_beta(a, b)."""
    x = np.clip(x, 0, 1)
    scale = log_beta(a, b) if scale is None else scale
    swap = x > (a + 1) / (a + b + 2)
    p, q, u = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        front = np.exp(p * np.log(u) + q * np.log1p(-u) - scale) / p
        c = np.ones_like(u)
        d = 1 - (p + q) * u / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for t in (m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + t * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + t / np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-13):
                break
        value = np.where(u <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


def beta_quantiles(level: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By Newton's steps between the logits of x, which keep their digits where a and b are far below 1, and of the share below x; a step
    out of the bracket halves it instead. The two are close to a line, so a few steps do; what is done is not looked at again."""
    low, high, scale = np.full(a.shape, -745.0), np.full(a.shape, 36.0), log_beta(a, b)
    z, target = np.clip(np.log(a) - np.log(b), -700.0, 30.0), math.log(level / (1 - level))
    at = np.arange(len(a))
    for _ in range(120):
        p, q, here = a[at], b[at], z[at]
        value = beta_cdf(1 / (1 + np.exp(-here)), p, q, scale[at])
        below = value < level
        low[at], high[at] = np.where(below, here, low[at]), np.where(below, high[at], here)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
            slope = np.exp(-p * np.logaddexp(0, -here) - q * np.logaddexp(0, here) - scale[at])
            new = here - (np.log(value) - np.log1p(-value) - target) * value * (1 - value) / slope
        new = np.where((new >= low[at]) & (new <= high[at]), new, (low[at] + high[at]) / 2)
        z[at] = new
        at = at[(np.abs(new - here) > 1e-9) & (high[at] - low[at] > 1e-13)]
        if not len(at):
            break
    return 1 / (1 + np.exp(-z))


def beta_quantile(level: float, a: Column, b: Column) -> Column:
    """Quantile of Beta(a, b), in Arrow batches; null where either is null or not above 0."""

    @F.pandas_udf("double")
    def quantile(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(float, na_value=np.nan), b.to_numpy(float, na_value=np.nan)
        ok = (x > 0) & (y > 0)
        out = np.full(len(x), np.nan)
        if ok.any():
            out[ok] = beta_quantiles(level, x[ok], y[ok])
        return pd.Series(out).where(ok)

    return quantile(a, b)
