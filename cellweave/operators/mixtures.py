"""Predictive mixtures: a count's expectation under several regimes, weighted by how well each foretold what was held out.

A cell's members are arrays of weights, expectations and dispersions, so tails, scores and quantiles are columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from cellweave.functions import distributions as d

RULES = ("flat", "last", "damped", "linear")


def _flat(*columns: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each member, and the members' values end to end."""
    return np.repeat(np.arange(len(columns[0])), columns[0].str.len().to_numpy(int)), [np.concatenate([*c.to_list(), []]).astype(float) for c in columns]


def _summed(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, values, minlength=n)


@pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("pit", "z", "upper", "mean", "phi", "loglik")]))
def mixture_score(y: pd.Series, weight: pd.Series, mu: pd.Series, phi: pd.Series, v: pd.Series) -> pd.DataFrame:
    """pit: F(y - 1) + v P(y); z from the nearer tail; upper: P(Y >= y); mean; phi of the negative binomial with the
    mixture's mean and variance (1e9 where that has no excess spread); loglik: log P(y)."""
    n, k, r = len(y), y.to_numpy(float), v.to_numpy(float)
    row, (w, m, f) = _flat(weight, mu, phi)
    w = w / _summed(row, w, n)[row]
    above = np.minimum(_summed(row, w * d.nb_sf(k[row] - 1, m, f), n), 1.0)
    p = _summed(row, w * np.exp(d.nb_logpmf(k[row], m, f)), n)
    low, high = np.clip(1 - above + r * p, 1e-15, 1 - 1e-15), np.clip(above - r * p, 1e-300, 1.0)
    z = np.where(low > 0.5, d.normal_isf(np.minimum(high, 0.5)), -d.normal_isf(np.minimum(low, 0.5)))
    mean = _summed(row, w * m, n)
    over = _summed(row, w * (m * m + m * m / f), n) - mean**2
    return pd.DataFrame({"pit": low, "z": z, "upper": above, "mean": mean, "phi": np.where(over > 1e-9 * mean**2, mean**2 / np.maximum(over, 1e-300), 1e9), "loglik": np.log(np.maximum(p, 1e-300))})


@pandas_udf(T.LongType())
def mixture_quantile(p: pd.Series, weight: pd.Series, mu: pd.Series, phi: pd.Series) -> pd.Series:
    """The least k with P(Y <= k) >= p, by doubling and bisection over all rows at once."""
    n, q = len(p), p.to_numpy(float)
    row, (w, m, f) = _flat(weight, mu, phi)
    w = w / _summed(row, w, n)[row]
    short = lambda k: _summed(row, w * d.nb_sf(k[row], m, f), n) > 1 - q
    high = np.ones(n)
    while (more := short(high)).any():
        high[more] *= 2
    low = np.full(n, -1.0)
    while (high - low > 1).any():
        mid = np.floor((low + high) / 2)
        over = short(mid) & (mid > low)
        low, high = np.where(over, mid, low), np.where(over | (mid <= low), high, mid)
    return pd.Series(high.astype("int64"))


def _ahead(x: np.ndarray, steps: int, damping: float) -> np.ndarray:
    """Log rates ``steps`` periods on by each rule, from those known (rows are units)."""
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    slope = (x @ t) / max((t * t).sum(), 1e-12)
    recent = x[:, -5:]
    s = np.arange(recent.shape[1]) - (recent.shape[1] - 1) / 2
    late = (recent @ s) / max((s * s).sum(), 1e-12)
    h = np.arange(1, steps + 1)
    faded = damping * (1 - damping**h) / (1 - damping)
    last = recent[:, -3:].mean(axis=1)
    return np.stack([np.repeat(x.mean(axis=1)[:, None], steps, 1), np.repeat(last[:, None], steps, 1), x[:, [-1]] + late[:, None] * faded, x.mean(axis=1)[:, None] + slope[:, None] * ((x.shape[1] - 1) / 2 + h)], axis=1)


def regimes(cells: DataFrame, last: int, *, steps: int, by: str = "g", at: str = "year", origins: int = 4, least: int = 3, damping: float = 0.5, phi: float = 100.0) -> DataFrame:
    """(by, weight, rate): for each group of ``cells`` (by, at, y, n) weights of the rules and their log rates in the next ``steps`` periods.

    rate[r][h - 1] is rule r's. Rules: the mean of all periods, of the last three, the last one with the recent slope fading,
    the line through all. Each of the last ``origins`` known periods is foretold by every rule from what came before (at
    least ``least`` periods); a rule's weight is its likelihood there, negative binomial with ``phi``. A group with too few
    periods weighs all rules alike. Groups are summed in Spark and fitted many at once.
    """
    sums = cells.where(F.col(at) <= last).groupBy(by, at).agg(F.sum("y").cast("double").alias("y"), F.sum("n").cast("double").alias("n"))
    rows = sums.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(at, "y", "n"))).alias("s")).select(by, F.col("s.y").alias("y"), F.col("s.n").alias("n"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame["y"].str.len()):
                y, n = np.stack(part["y"].to_list()), np.stack(part["n"].to_list())
                x = np.log((y + 0.5) / np.maximum(n, 1e-9))
                score = np.zeros((len(part), len(RULES)))
                for o in range(max(least, size - origins), size):
                    mu = np.exp(_ahead(x[:, :o], 1, damping)[:, :, 0]) * n[:, [o]]
                    score += d.nb_logpmf(y[:, [o]], mu, phi)
                w = np.exp(score - score.max(axis=1, keepdims=True))
                rate = _ahead(x, steps, damping)
                yield pd.DataFrame({by: part[by].to_list(), "weight": list(w / w.sum(axis=1, keepdims=True)), "rate": [list(r) for r in rate]})

    return rows.mapInPandas(work, f"{by} {dict(cells.dtypes)[by]}, weight array<double>, rate array<array<double>>")


def predictive(cells: DataFrame, groups: DataFrame, shifts: DataFrame, last: int, *, by: str = "g", phi: Column) -> DataFrame:
    """Later cells with their members: weight, mu, phi (arrays over the rules).

    cells: u, by, year, y, n; groups: of ``regimes``; shifts: (u, at, shift, shift_var) of places' courses. A member's
    expectation is n times its rate times the place's shift; the shift's variance widens it. Places without a course
    have none.
    """
    rows = cells.where(F.col("year") > last).join(F.broadcast(groups), by)  # a row for each group, not for each place
    rows = rows.join(shifts.withColumnRenamed("at", "year"), ["u", "year"], "left").na.fill({"shift": 0.0, "shift_var": 0.0})
    step = (F.col("year") - last - 1).cast("int")
    mu = F.transform("rate", lambda r: F.col("n") * F.exp(r[step] + F.col("shift")))
    wide = 1 / (1 / phi + F.col("shift_var"))
    return rows.withColumns({"mu": mu, "phi": F.transform("rate", lambda r: wide)}).drop("rate", "shift", "shift_var")
