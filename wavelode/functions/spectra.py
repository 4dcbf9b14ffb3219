"""Spectra and autoregressive coefficients of whole series: numpy over Arrow batches where a transform
or a recursion is quadratic as an expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _by_length(x: pd.Series, work) -> pd.Series:
    """work on stacks of equally long rows; null and empty series give null."""
    lens = np.array([0 if v is None else len(v) for v in x], int)
    out: list = [None] * len(x)
    for n in np.unique(lens):
        if n:
            at = np.flatnonzero(lens == n)
            for i, row in zip(at, work(np.stack([np.asarray(x.iloc[k], float) for k in at])), strict=True):
                out[i] = row
    return pd.Series(out, dtype=object)


def _packed(a: np.ndarray) -> np.ndarray:
    n = a.shape[1]
    even = np.pad(a, ((0, 0), (0, n % 2)))
    return np.fft.fft(even[:, ::2] + 1j * even[:, 1::2], n)


def _array_udf(work):
    """A kernel on stacks of equally long rows as an Arrow UDF of one array column."""

    def run(x: pd.Series) -> pd.Series:
        return _by_length(x, work)

    return F.pandas_udf(run, "array<double>")


def power_spectrum(x: str) -> Column:
    """|DFT_k|^2, k = 0 .. n/2."""
    return _array_udf(lambda a: np.abs(np.fft.rfft(a)) ** 2)(x)


def power_spectrum_packed(x: str) -> Column:
    """|DFT_k|^2, k = 0 .. n-1, of z_j = x_2j + i x_2j+1 followed by zeros."""
    return _array_udf(lambda a: np.abs(_packed(a)) ** 2)(x)


def dft_raw(x: str) -> Column:
    """Re and Im in turn of the packed transform."""
    return _array_udf(lambda a: np.stack([_packed(a).real, _packed(a).imag], 2).reshape(len(a), -1))(x)


def autocorrelations(a: np.ndarray, most: int, lags: list[int] | None = None) -> np.ndarray:
    """Of rows of values, at lags 1..most: the correlation of x[0..n-lag) with x[lag..n), each with a mean
    and variance of its own; 0 where that is undefined or beyond 1. lags: the only ones that are worked out."""
    n, out = a.shape[1], np.zeros((len(a), most))
    mean = lambda v: np.add.reduce(v, 1) / v.shape[1]
    for lag in range(1, min(most, n - 1) + 1):
        if lags is not None and lag not in lags:
            continue
        u, v = a[:, : n - lag], a[:, lag:]
        mu, mv = mean(u), mean(v)
        vu, vv = mean(u * u) - mu * mu, mean(v * v) - mv * mv
        ok = (vu > 1e-12) & (vv > 1e-12)
        r = (mean(u * v) - mu * mv) / np.sqrt(np.where(ok, vu * vv, 1))
        out[:, lag - 1] = np.where(ok & (np.abs(r) <= 1), r, 0)
    return out


def products(a: np.ndarray, most: int) -> np.ndarray:
    """The variant for values that are normalised already: the sum of x_j x_j+lag over the length; 0 beyond 1."""
    n, out = a.shape[1], np.zeros((len(a), most))
    for lag in range(1, min(most, n - 1) + 1):
        out[:, lag - 1] = (a[:, : n - lag] * a[:, lag:]).sum(1) / n
    return np.where(np.abs(out) <= 1, out, 0)


def acf(df: DataFrame, most: int, x: str = "x", normalized: bool = False) -> DataFrame:
    """df with acf: array of autocorrelations at lags 1..most; normalized: of values that are."""
    work = products if normalized else autocorrelations
    return df.withColumn("acf", _array_udf(lambda a: work(a, most))(x))


def series_lag(n: int, end_terms: int = 4) -> int:
    """The largest lag for whole series: a quarter of the length, 100 at most; the whole length where that is
    below 10; never into the last end_terms values."""
    lag = min(n // 4, 100)
    lag = min(n if lag < 10 else lag, n - end_terms)
    return n if lag < 0 else lag


def durbin_levinson(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partial autocorrelations and the last order's coefficients from rows of autocorrelations r_1..r_p.
    Values that aren't numbers become 0."""
    rows, p = r.shape
    phi, pacf = np.zeros((rows, p)), np.zeros((rows, p))
    with np.errstate(all="ignore"):
        for k in range(p):
            num = r[:, k] - (phi[:, :k] * r[:, :k][:, ::-1]).sum(1)
            den = 1 - (phi[:, :k] * r[:, :k]).sum(1)
            last = np.nan_to_num(num / den, nan=0.0, posinf=0.0, neginf=0.0)
            phi[:, :k] = phi[:, :k] - last[:, None] * phi[:, :k][:, ::-1]
            phi[:, k] = last
            pacf[:, k] = last
    return pacf, phi


def pacf(r: str) -> Column:
    return _array_udf(lambda a: durbin_levinson(a)[0])(r)


def ar_coefficients(r: str) -> Column:
    return _array_udf(lambda a: durbin_levinson(a)[1])(r)


def orders(a: np.ndarray, n: int) -> np.ndarray:
    """For rows of autocorrelations of n values, the order before the first rise of n ln(variance) + 2 order."""
    partial, _ = durbin_levinson(a)
    variance = np.maximum(np.cumprod(1 - partial**2, 1), 1e-300)
    score = n * np.log(variance) + 2 * np.arange(1, a.shape[1] + 1)
    rises = np.diff(score, axis=1) > 0
    return np.where(rises.any(1), rises.argmax(1) + 1, a.shape[1])


def best_order(r: str, n: int) -> Column:
    """orders() of an array column, as an array of one."""
    return _array_udf(lambda a: orders(a, n)[:, None].astype(float))(r)


def max_lag(n: int) -> int:
    """Half an interval's length, 100 at most; the whole length where that is below 16."""
    lag = min(n // 2, 100)
    return n if lag < 16 else lag


FILTERS = {
    "ACF": ("acf",), "PACF": ("pacf",), "ARMA": ("ar",), "PS": ("ps",), "DFT": ("dft",), "PLAIN_PS": ("plain",),
    "ACF_PACF_ARMA": ("acf", "pacf", "ar"), "ACF_PACF_ARMA_PS_combined": ("acf", "pacf", "ar", "ps"), "ACF_PACF_ARMA_DFT": ("acf", "pacf", "ar", "dft"),
}


def filtered(series: DataFrame, n: int, kind: str) -> DataFrame:
    """x of length n replaced by array column f: the filter's parts one after another."""
    parts = FILTERS[kind]
    rows = acf(series, max_lag(n)) if {"acf", "pacf", "ar"} & set(parts) else series
    made: dict[str, Column] = {
        "acf": F.col("acf") if "acf" in rows.columns else F.lit(None), "pacf": pacf("acf"), "ar": ar_coefficients("acf"),
        "ps": power_spectrum_packed("x"), "plain": power_spectrum("x"), "dft": dft_raw("x"),
    }
    whole = F.concat(*[made[p] for p in parts]) if len(parts) > 1 else made[parts[0]]
    return rows.withColumn("f", whole).drop("x", "acf")


def filter_values(a: np.ndarray, kind: str, at: np.ndarray | None = None) -> np.ndarray:
    """The filter's parts of rows of values, one after another: filtered() inside a task. at: the places that are wanted."""
    parts = FILTERS[kind]
    if at is not None:
        if parts == ("acf",):
            return autocorrelations(a, max_lag(a.shape[1]), (np.asarray(at) + 1).tolist())[:, at]
        return filter_values(a, kind)[:, at]
    r = autocorrelations(a, max_lag(a.shape[1])) if {"acf", "pacf", "ar"} & set(parts) else None
    made = {
        "acf": lambda: r, "pacf": lambda: durbin_levinson(r)[0], "ar": lambda: durbin_levinson(r)[1], "ps": lambda: np.abs(_packed(a)) ** 2,
        "plain": lambda: np.abs(np.fft.rfft(a)) ** 2, "dft": lambda: np.stack([_packed(a).real, _packed(a).imag], 2).reshape(len(a), -1),
    }
    return np.concatenate([made[p]() for p in parts], 1)
