"""Distribution functions without SciPy: NumPy kernels, and Arrow-vectorised columns over them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_ppf = np.vectorize(lambda p: NormalDist().inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5) if p in (0, 1) else math.nan, otypes=[float])


def normal_sf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def normal_ppf(p: np.ndarray) -> np.ndarray:
    return _ppf(np.asarray(p, float))


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
            break
    out = np.where((y <= 0), 0.0, front * h)
    return np.where(swap, 1 - out, out)


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        term = total = 1 / a
        for n in range(1, 1000):
            term = term * x / (a + n)
            total = total + term
            if np.nanmax(np.abs(term) / np.abs(total), initial=0) < 1e-16:
                break
        b = x + 1 - a
        c = np.full_like(x, 1e300)
        d = 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = b + an / c
            h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


def chi2_sf_np(x, df):
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def t_sf_np(t, df):
    """Upper tail of |t|."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf_np(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def binomial_cdf_np(k, n, p):
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    inner = (k >= 0) & (k < n)
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, beta_inc(np.where(inner, n - k, 1), np.where(inner, k + 1, 1), 1 - p)))


def _wrapped(kernel, arity: int):
    def one(a: pd.Series) -> pd.Series:
        return pd.Series(_safe(kernel, a))

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_safe(kernel, a, b))

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(_safe(kernel, a, b, c))

    return pandas_udf({1: one, 2: two, 3: three}[arity], "double")


def _safe(kernel, *args: pd.Series) -> np.ndarray:
    """NaN where an argument is missing."""
    cols = [a.to_numpy(dtype=float, na_value=np.nan) for a in args]
    good = ~np.isnan(np.stack(cols)).any(axis=0)
    out = np.full(len(cols[0]), np.nan)
    if good.any():
        out[good] = kernel(*[c[good] for c in cols])
    return out


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    return _wrapped(binomial_cdf_np, 3)(k, n, p)


def chi2_sf(x: Column, df: Column) -> Column:
    return _wrapped(chi2_sf_np, 2)(x, df)


def t_sf(t: Column, df: Column) -> Column:
    return _wrapped(t_sf_np, 2)(t, df)


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    return _wrapped(f_sf_np, 3)(f, d1, d2)


def z_sf(z: Column) -> Column:
    return _wrapped(normal_sf, 1)(z)


def z_ppf(p: Column) -> Column:
    return _wrapped(normal_ppf, 1)(p)
