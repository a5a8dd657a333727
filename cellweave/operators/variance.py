"""How much place-years vary beyond their cells' own dispersion, by level of a hierarchy: likelihood from sums per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweave.functions import distributions as d
from cellweave.sources.scratch import staged

#: Log variances that are tried: from a ten-thousandth (one per cent of the expectation) to a hundred, as a grid whose best point is refined by a parabola.
GRID = np.linspace(np.log(1e-4), np.log(1e2), 48)


def nb_quantile(p: float, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """The least k with P(Y <= k) >= p for each cell, by doubling and bisection."""
    low, high = np.full(mu.shape, -1.0), np.ones(mu.shape)
    while (short := d.nb_sf(high, mu, phi) > 1 - p).any():
        high = np.where(short, 2 * high, high)
    while (high - low > 1).any():
        mid = np.floor((low + high) / 2)
        over = d.nb_sf(mid, mu, phi) > 1 - p
        low, high = np.where(over, mid, low), np.where(over, high, np.maximum(mid, low + 1))
    return high


def likelihoods(y: np.ndarray, mu: np.ndarray, own: np.ndarray, now: np.ndarray, trim: float) -> np.ndarray:
    """Log likelihood of each cell (rows) at each variance of GRID, 0 for a cell beyond its bounds.

    own: the cells' 1 / phi; now: the variance that sets the bounds, the ``trim`` and 1 - ``trim`` quantiles. A kept cell's
    likelihood is divided by its chance to lie within them, so leaving cells out doesn't bias what is left.
    """
    phi_now = 1 / np.maximum(own + now, 1e-9)
    keep = mu > 1e-9
    low, high = np.zeros_like(y), np.full_like(y, np.inf)
    if trim > 0:
        low, high = nb_quantile(trim, mu, phi_now), nb_quantile(1 - trim, mu, phi_now)
        keep &= (y >= low) & (y <= high)
    out = np.zeros((len(y), len(GRID)))
    if not keep.any():
        return out
    phi = 1 / np.maximum(own[keep, None] + np.exp(GRID)[None, :], 1e-9)
    at, m = y[keep, None], mu[keep, None]
    out[keep] = d.nb_logpmf(at, m, phi)
    if trim > 0:
        inside = d.nb_sf(low[keep, None] - 1, m, phi) - d.nb_sf(high[keep, None], m, phi)
        out[keep] -= np.log(np.maximum(inside, 1e-12))
    return out


def _peak(total: np.ndarray) -> tuple[float, float]:
    """Where a log likelihood over GRID is largest, and the variance of that estimate (by its curvature)."""
    i = int(np.clip(total.argmax(), 1, len(GRID) - 2))
    a, b, c = total[i - 1 : i + 2]
    h, bend = GRID[1] - GRID[0], a - 2 * b + c
    if bend >= -1e-9 or not 0 < total.argmax() < len(GRID) - 1:
        return float(GRID[total.argmax()]), 1e6  # at an end, or flat: nothing is known but the direction
    return float(GRID[i] + h * (a - c) / (2 * bend)), float(-(h * h) / bend)


def place_year_variance(cells: DataFrame, levels: list[str] | None = None, *, trim: float = 0.005, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(cells' groups with log_variance and phi_extra, every level's groups) of Var(y) = mu + mu**2 / phi + mu**2 / phi_extra.

    cells: u, y, mu, phi and the ``levels``, coarse to fine (each group lies in one of the level before). Every group's log
    variance is estimated on its own cells by likelihood, then drawn towards its parent's by the spread that the groups of
    its level show beyond their own uncertainty: a group that knows little keeps its parent's. Cells beyond the
    ``trim`` quantiles on either side are left out, by bounds that are set anew in each of ``rounds``; so departures
    that the variance must not absorb don't. A cell's likelihoods over the grid are summed per group in Spark; a group is
    48 numbers.
    """
    levels = levels or []
    rows = staged(cells.select("u", *levels, F.col("y").cast("double").alias("y"), F.col("mu").cast("double").alias("mu"), F.when(F.col("phi") < 1e8, 1 / F.col("phi")).otherwise(0.0).alias("own")).withColumn("_all", F.lit("all")), "variance")
    chain = ["_all", *levels]
    finest = chain[-1]
    kinds = dict(rows.dtypes)
    bounds = rows.select(*chain).distinct().withColumn("now", F.lit(0.0))
    table = None

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for low in range(0, len(f), 2000):
                part = f.iloc[low : low + 2000]
                ll = likelihoods(*(part[c].to_numpy(float) for c in ("y", "mu", "own", "now")), trim)
                codes = part.groupby(chain, sort=False, dropna=False).ngroup().to_numpy()
                groups = part[chain].drop_duplicates()
                sums = np.zeros((len(groups), len(GRID)))
                np.add.at(sums, codes, ll)
                out = groups.iloc[np.repeat(np.arange(len(groups)), len(GRID))].reset_index(drop=True)
                yield out.assign(i=np.tile(np.arange(len(GRID)), len(groups)), ll=sums.ravel())

    def peaks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [_peak(np.asarray(x, float)) for x in f["ll"]]
            yield f.drop(columns="ll").assign(own_estimate=[g[0] for g in got], uncertainty=[g[1] for g in got])

    for _ in range(rounds if trim > 0 else 1):
        fine = staged(rows.join(bounds, chain).mapInPandas(each, ", ".join(f"{c} {kinds[c]}" for c in chain) + ", i int, ll double").groupBy(*chain, "i").agg(F.sum("ll").alias("ll")), "likelihoods")
        above, table = None, None
        for depth in range(len(chain)):
            keys = chain[: depth + 1]
            per = fine.groupBy(*keys, "i").agg(F.sum("ll").alias("ll")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "ll"))), lambda x: x["ll"]).alias("ll"))
            per = per.mapInPandas(peaks, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", own_estimate double, uncertainty double")
            if above is None:
                per = per.withColumns({"spread": F.lit(0.0), "log_variance": F.col("own_estimate")})
            else:
                per = staged(per.join(above, keys[:-1]), "level")
                w = F.col("uncertainty") < 1e5
                known = per.agg(F.coalesce(F.greatest(F.lit(0.0), F.avg(F.when(w, (F.col("own_estimate") - F.col("_parent")) ** 2 - F.col("uncertainty")))), F.lit(0.0)).alias("spread"))
                per = per.crossJoin(known)  # one row
                per = per.withColumn("log_variance", F.col("_parent") + F.col("spread") / (F.col("spread") + F.col("uncertainty")) * (F.col("own_estimate") - F.col("_parent"))).drop("_parent")
            per = staged(per, "level")
            above = per.select(*keys, F.col("log_variance").alias("_parent"))
            named = per.select(F.lit(keys[-1].removeprefix("_")).alias("level"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys[1:]]).alias("group"), "own_estimate", "uncertainty", "spread", "log_variance")
            table = named if table is None else table.unionByName(named)
        bounds = per.select(*chain, F.exp("log_variance").alias("now"))
    out = per.select(*levels, "log_variance", F.exp(-F.col("log_variance")).alias("phi_extra"))
    return (out if levels else out.withColumn("level", F.lit(finest.removeprefix("_")))), table


def with_extra(cells: DataFrame, groups: DataFrame, levels: list[str]) -> DataFrame:
    """``cells`` with phi made smaller by the extra variance of their groups."""
    rows = cells.join(F.broadcast(groups.select(*levels, "phi_extra")), levels)  # a row a group
    return rows.withColumn("phi", 1 / (1 / F.col("phi") + 1 / F.col("phi_extra"))).drop("phi_extra")
