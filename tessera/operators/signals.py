"""Filters, resampling and phases of single series: numpy inside, one series a group.

Each series (its keys `by`) is a group of bounded length; Spark spreads the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_series(frame: DataFrame, by: Sequence[str], function: Callable[[np.ndarray], np.ndarray], row: str = "row_id") -> DataFrame:
    """by..., row_id, value of function(values in order) for each series; the length may change."""
    kinds = dict(frame.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = function(group.sort_values(row)["value"].to_numpy(float))
        return pd.DataFrame({**{k: [group[k].iloc[0]] * len(made) for k in by}, row: np.arange(len(made)), "value": made})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), f"{row} long", "value double"])
    return frame.select(*by, row, "value").groupBy(*by).applyInPandas(run, schema)


def pchip_slopes(y: np.ndarray) -> np.ndarray:
    """Slopes of the monotone cubic through unit-spaced points (Fritsch and Carlson, as Butland weighs them)."""
    n = len(y)
    if n < 3:
        return np.full(n, y[1] - y[0] if n == 2 else 0.0)
    d = np.diff(y)
    slopes = np.zeros(n)
    same = d[:-1] * d[1:] > 0
    slopes[1:-1][same] = 2 / (1 / d[:-1][same] + 1 / d[1:][same])

    def end(a: float, b: float) -> float:
        s = (3 * a - b) / 2
        if s * a <= 0:
            return 0.0
        return 3 * a if a * b <= 0 and abs(s) > 3 * abs(a) else s

    slopes[0], slopes[-1] = end(d[0], d[1]), end(d[-1], d[-2])
    return slopes


def pchip(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The interpolant at any places; beyond the ends the end pieces go on."""
    if len(y) < 2:
        return np.full(len(at), y[0] if len(y) else np.nan)
    k = np.clip(np.floor(at).astype(int), 0, len(y) - 2)
    t, m = at - k, pchip_slopes(y)
    a, b = y[k], y[k + 1]
    return a * (1 + 2 * t) * (1 - t) ** 2 + m[k] * t * (1 - t) ** 2 + b * t * t * (3 - 2 * t) + m[k + 1] * t * t * (t - 1)


def resample(frame: DataFrame, by: Sequence[str], factor: float) -> DataFrame:
    """Each series at arange(0, n, 1 / factor)."""
    return per_series(frame, by, lambda y: pchip(y, np.arange(0, len(y), 1 / factor)))


def butter_gain(freq: np.ndarray, low: float | None, high: float | None, order: int = 5) -> np.ndarray:
    """Squared Butterworth gain (forward and backward passes): low cuts below, high cuts above."""
    gain = np.ones_like(freq)
    with np.errstate(divide="ignore", over="ignore"):
        if low:
            gain /= 1 + (low / np.maximum(freq, 1e-300)) ** (2 * order)
        if high:
            gain /= 1 + (freq / high) ** (2 * order)
    return gain


def bandpass(frame: DataFrame, by: Sequence[str], sampling_freq: float, low: float | None = None, high: float | None = None, order: int = 5) -> DataFrame:
    """Zero-phase Butterworth filtering in the frequency domain, over an odd reflection of the ends."""
    return per_series(frame, by, lambda y: bandpassed(y, sampling_freq, low, high, order))


def bandpassed(y: np.ndarray, sampling_freq: float, low: float | None, high: float | None, order: int = 5) -> np.ndarray:
    if len(y) < 2:
        return y
    wide = np.concatenate([2 * y[0] - y[:0:-1], y, 2 * y[-1] - y[-2::-1]])
    freq = np.fft.rfftfreq(len(wide), 1 / sampling_freq)
    return np.fft.irfft(np.fft.rfft(wide) * butter_gain(freq, low, high, order), len(wide))[len(y) - 1 : 2 * len(y) - 1]


def phase_randomized(y: np.ndarray, seed: int) -> np.ndarray:
    """Random phases on the positive frequencies; mean and Nyquist stay, so do all powers."""
    f = np.fft.rfft(y)
    inner = slice(1, (len(y) - 1) // 2 + 1)
    f[inner] = f[inner] * np.exp(2j * np.pi * np.random.default_rng(seed).random(len(f[inner])))
    return np.fft.irfft(f, len(y))


def phase_randomize(frame: DataFrame, by: Sequence[str], seed: int = 0) -> DataFrame:
    return per_series(frame, by, lambda y: phase_randomized(y, seed))


def hilbert_angle(y: np.ndarray) -> np.ndarray:
    """The angle of the analytic signal."""
    n = len(y)
    f = np.fft.fft(y)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.angle(np.fft.ifft(f * weight))


def phases(frame: DataFrame, by: Sequence[str], sampling_freq: float, low: float, high: float) -> DataFrame:
    """The instantaneous phase of each series in a band: the first step of inter-subject phase synchrony;
    phase_summary over subjects at each time is the second."""
    return per_series(frame, by, lambda y: hilbert_angle(bandpassed(y - y.mean(), sampling_freq, low, high)))
