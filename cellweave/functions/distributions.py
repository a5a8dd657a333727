"""Distribution functions on numpy arrays: normal, gamma, beta, Poisson, negative binomial, beta-binomial."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def lgamma(x):
    """log of the gamma function for positive x (Stirling's series above 10, recurrence below)."""
    x = np.asarray(x, float)
    shift = np.maximum(0, np.ceil(10 - x))
    out, y = np.zeros_like(x), x.copy()
    for _ in range(int(shift.max(initial=0))):
        low = y < 10
        out = np.where(low, out - np.log(np.where(low, y, 1)), out)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y
    return out + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series


def normal_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def normal_cdf(z):
    return normal_sf(-np.asarray(z, float))


def normal_isf(p):
    """z with upper tail p, by bisection on the tail's logarithm and Newton steps."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(80):
        mid = (low + high) / 2
        above = normal_sf(mid) > p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def gamma_sf(x, a):
    """Upper regularised incomplete gamma function Q(a, x): series below a + 1, continued fraction above."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    front = np.exp(np.where(x > 0, a * np.log(np.where(x > 0, x, 1)) - x - lgamma(a), -np.inf))
    small = x < a + 1
    term = 1 / a
    total, k = term.copy(), a.copy()
    for _ in range(100_000):
        k = k + 1
        term = term * np.where(small, x, 0) / k
        total = total + term
        if (term <= 1e-17 * total).all():
            break
    b = np.where(small, a + 2, x) + 1 - a
    c = np.full(x.shape, 1e300)
    d = 1 / b
    h = d.copy()
    for i in range(1, 100_000):
        an = -i * (i - a)
        b = b + 2
        d = 1 / np.where((t := an * d + b) == 0, 1e-300, t)
        c = np.where((t := b + an / c) == 0, 1e-300, t)
        step = c * d
        h = h * step
        if (small | (np.abs(step - 1) < 1e-15)).all():
            break
    return np.clip(np.where(small, 1 - front * total, front * h), 0, 1)


def gamma_cdf(x, a):
    return 1 - gamma_sf(x, a)


def chi2_sf(x, df):
    return gamma_sf(np.asarray(x, float) / 2, np.asarray(df, float) / 2)


def chi2_isf(p, df):
    """x with upper tail p, by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    low, high = np.zeros(p.shape), df + 50 * np.sqrt(2 * df + 1) + 100
    for _ in range(100):
        mid = (low + high) / 2
        above = np.where(df > 0, chi2_sf(mid, np.maximum(df, 1e-9)), 0) > p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def beta_cdf(x, a, b):
    """Regularised incomplete beta function by its continued fraction."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(y) + b * np.log1p(-y)) / a
    c, d = np.ones(x.shape), 1 / (1 - (a + b) * y / (a + 1))
    h = d.copy()
    for m in range(1, 100_000):
        for an in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where((t := 1 + an * d) == 0, 1e-300, t)
            c = np.where((t := 1 + an / c) == 0, 1e-300, t)
            step = c * d
            h = h * step
        if (~inside | (np.abs(step - 1) < 1e-15)).all():
            break
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.clip(np.where(flip, 1 - out, out), 0, 1)


def poisson_sf(k, mu):
    """P(Y > k)."""
    k, mu = np.broadcast_arrays(np.asarray(k, float), np.asarray(mu, float))
    return np.where(k < 0, 1.0, gamma_cdf(mu, np.maximum(k, 0) + 1))


def nb_sf(k, mu, phi):
    """P(Y > k) of the negative binomial of mean mu and variance mu + mu**2 / phi; infinite phi is Poisson."""
    k, mu, phi = (np.asarray(v, float) for v in np.broadcast_arrays(k, mu, phi))
    finite = np.isfinite(phi) & (phi < 1e8)
    f, m = np.where(finite, phi, 1), np.maximum(mu, 1e-300)
    tail = beta_cdf(m / (m + f), np.maximum(k, 0) + 1, f)
    return np.where(k < 0, 1.0, np.where(finite, tail, poisson_sf(k, mu)))


def nb_logpmf(y, mu, phi):
    y, mu, phi = (np.asarray(v, float) for v in np.broadcast_arrays(y, mu, phi))
    m = np.maximum(mu, 1e-300)
    finite = np.isfinite(phi) & (phi < 1e8)
    f = np.where(finite, phi, 1)
    nb = lgamma(y + f) - lgamma(f) - lgamma(y + 1) + f * np.log(f / (f + m)) + y * np.log(m / (f + m))
    return np.where(finite, nb, y * np.log(m) - m - lgamma(y + 1))


def betabinom_logpmf(k, n, a, b):
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + a) + lgamma(n - k + b) - lgamma(n + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b)


def betabinom_tails(y: int, n: int, a: float, b: float) -> tuple[float, float]:
    """P(Y <= y) and P(Y >= y) of one beta-binomial, exactly."""
    p = np.exp(betabinom_logpmf(np.arange(n + 1.0), float(n), a, b))
    return float(min(1, p[: y + 1].sum())), float(min(1, p[y:].sum()))


def garwood(y, level: float = 0.95):
    """Exact interval of a Poisson mean."""
    y = np.asarray(y, float)
    tail = (1 - level) / 2
    return np.where(y > 0, chi2_isf(1 - tail, np.maximum(2 * y, 1e-9)) / 2, 0.0), chi2_isf(tail, 2 * y + 2) / 2


def clopper_pearson(k, n, level: float = 0.95):
    """Exact interval of a share, by bisection on the beta distribution."""
    k, n = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float))
    tail = (1 - level) / 2

    def quantile(p, a, b):
        low, high = np.zeros(a.shape), np.ones(a.shape)
        for _ in range(60):
            mid = (low + high) / 2
            above = beta_cdf(mid, a, b) > p
            low, high = np.where(above, low, mid), np.where(above, mid, high)
        return (low + high) / 2

    low = np.where(k > 0, quantile(tail, np.maximum(k, 1e-9), n - k + 1), 0.0)
    high = np.where(k < n, quantile(1 - tail, k + 1, np.maximum(n - k, 1e-9)), 1.0)
    return low, high
