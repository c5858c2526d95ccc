"""Distribution functions on numpy, and Arrow-batched column functions of them.

Spark has no t, F or normal distribution; these run once for each aggregated row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (y > 0) & (y < 1)
    z = np.where(inside, y, 0.5)
    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / np.where(np.abs(1 + num * d) < tiny, tiny, 1 + num * d)
                c = np.where(np.abs(1 + num / c) < tiny, tiny, 1 + num / c)
                h = h * c * d
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        value = front * h
    value = np.where(inside, value, (y >= 1).astype(float))
    out = np.where(swap, 1 - value, value)
    return np.where(np.isnan(x), np.nan, out)


def t_sf2(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        return np.where(np.isinf(t), 0.0, betainc(df / 2, 0.5, df / (df + t * t)))


def f_sf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def norm_sf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(np.asarray(z, float) / math.sqrt(2))


def norm_isf(p: np.ndarray) -> np.ndarray:
    """The normal quantile of an upper tail: a start from the tail's asymptotics, then Newton's steps on
    the logarithm of the tail."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    upper = p <= 0.5
    q = np.where(upper, p, 1 - p)
    z = np.sqrt(np.maximum(-2 * np.log(q) - np.log(2 * np.pi * np.maximum(-2 * np.log(q), 1e-9)), 0.0))
    for _ in range(60):
        sf = np.maximum(norm_sf(z), 1e-320)
        density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        step = (np.log(sf) - np.log(q)) * sf / np.maximum(density, 1e-320)
        z = z + step
        if np.all(np.abs(step) < 1e-13 * (1 + np.abs(z))):
            break
    return np.where(upper, z, -z)


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else float(betainc(k, n - k + 1, p)) if k <= n else 0.0


@F.pandas_udf(T.DoubleType())
def p_of_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of t and df; null where either is."""
    return pd.Series(t_sf2(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def p_of_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(*(v.to_numpy(float, na_value=np.nan) for v in (f, d1, d2))))


@F.pandas_udf(T.DoubleType())
def z_of_p(p: pd.Series, sign: pd.Series) -> pd.Series:
    """The normal score of a two-sided p, with the sign of a statistic."""
    return pd.Series(np.sign(sign.to_numpy(float)) * norm_isf(np.clip(p.to_numpy(float) / 2, 1e-300, 1)))
