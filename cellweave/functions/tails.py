"""Tail probabilities as Spark columns: vectorised over Arrow batches, since Spark has no such functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from cellweave.functions import distributions as d


def _pair(a: str, b: str) -> T.StructType:
    return T.StructType([T.StructField(a, T.DoubleType()), T.StructField(b, T.DoubleType())])


@pandas_udf(T.DoubleType())
def nb_upper(y: pd.Series, mu: pd.Series, phi: pd.Series) -> pd.Series:
    """P(Y >= y)."""
    return pd.Series(d.nb_sf(y.to_numpy(float) - 1, mu.to_numpy(float), phi.to_numpy(float)))


@pandas_udf(T.DoubleType())
def poisson_upper(y: pd.Series, mu: pd.Series) -> pd.Series:
    """P(Y >= y)."""
    return pd.Series(d.poisson_sf(y.to_numpy(float) - 1, mu.to_numpy(float)))


@pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(2 * d.normal_sf(np.abs(z.to_numpy(float))))


@pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(d.chi2_sf(x.to_numpy(float), df.to_numpy(float)))


@pandas_udf(T.DoubleType())
def f_upper(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """P(F >= f) on a and b degrees of freedom."""
    x, m, n = (s.to_numpy(float) for s in (f, a, b))
    return pd.Series(d.beta_cdf(n / (n + m * np.maximum(x, 0)), n / 2, m / 2))


@pandas_udf(_pair("low", "high"))
def poisson_interval(y: pd.Series) -> pd.DataFrame:
    low, high = d.garwood(y.to_numpy(float))
    return pd.DataFrame({"low": low, "high": high})


@pandas_udf(_pair("low", "high"))
def share_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    low, high = d.clopper_pearson(k.to_numpy(float), n.to_numpy(float))
    return pd.DataFrame({"low": low, "high": high})


@pandas_udf(_pair("u", "z"))
def randomised_pit(y: pd.Series, mu: pd.Series, phi: pd.Series, v: pd.Series) -> pd.DataFrame:
    """u = F(y - 1) + v p(y), and z from the nearer tail."""
    a, m, f, r = (s.to_numpy(float) for s in (y, mu, phi, v))
    above = d.nb_sf(a - 1, m, f)  # P(Y >= y)
    p = np.exp(d.nb_logpmf(a, m, f))
    u = np.clip(1 - above + r * p, 1e-15, 1 - 1e-15)
    upper = np.clip(above - r * p, 1e-300, 1)
    return pd.DataFrame({"u": u, "z": np.where(u > 0.5, d.normal_isf(np.clip(upper, 1e-300, 0.5)), -d.normal_isf(np.clip(u, 1e-300, 0.5)))})


@pandas_udf(T.LongType())
def nb_threshold(mu: pd.Series, phi: pd.Series, tail: pd.Series) -> pd.Series:
    """The least k with P(Y >= k) <= tail, by doubling and bisection."""
    m, f, t = (s.to_numpy(float) for s in (mu, phi, tail))
    high = np.maximum(1.0, np.ceil(m))
    while (big := d.nb_sf(high - 1, m, f) > t).any():
        high = np.where(big, high * 2, high)
    low = np.zeros_like(high)
    while (high - low > 1).any():
        mid = np.floor((low + high) / 2)
        over = d.nb_sf(mid - 1, m, f) > t
        low, high = np.where(over, mid, low), np.where(over, high, np.maximum(mid, low + 1))
    return pd.Series(high.astype("int64"))
