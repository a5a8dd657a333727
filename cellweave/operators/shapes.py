"""Which course a series takes: interventions under serially correlated noise, abrupt or gradual change, whose profile moved.

Series are rows with arrays (``courses.series``); all of a batch with as many periods are worked at once in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweave.functions import distributions as d

#: Fixed values of the methods: decay of a passing change, the gap in deviance that decides a shape, the least counts.
DECAY, GAP, LEAST_EVENTS, LEAST_MOVED = 0.7, 6.0, 5, 20


def patterns(periods: int) -> tuple[np.ndarray, list[tuple[str, int]]]:
    """A column for each intervention that may begin at each period, and its name and beginning."""
    lag = np.arange(periods)[:, None] - np.arange(periods)[None, :]  # periods since the beginning
    on = lag >= 0
    kinds = {"spike": lag == 0, "transient": on * DECAY ** np.maximum(lag, 0), "step": on, "trend": np.maximum(lag + 1, 0)}
    first = {"spike": 0, "transient": 0, "step": 1, "trend": 0}
    last = {"transient": periods - 1}
    named = [(k, t) for t in range(periods) for k in kinds if first[k] <= t < last.get(k, periods)]
    return np.stack([kinds[k][:, t] for k, t in named], axis=1).astype(float), named


def interventions(y: np.ndarray, mu: np.ndarray, cov: np.ndarray, critical: float | None = None) -> tuple[list[list[tuple[str, int, float, float]]], float]:
    """For each row the interventions (name, beginning, size, z) that remain after adding and dropping, and the z demanded.

    Generalised least squares on y - mu under ``cov``: the strongest intervention given those taken is taken while it
    reaches ``critical`` (3, and up to 4 in long series); then the weakest in the joint fit goes until all reach it.
    """
    rows, periods = y.shape
    if critical is None:
        critical = min(max(3 + (periods - 50) / 400, 3.0), 4.0)
    x, named = patterns(periods)
    ridge = 1e-9 * np.maximum(np.trace(cov, axis1=1, axis2=2) / periods, 1e-12)
    weighted = np.matmul(x.T, np.linalg.inv(cov + ridge[:, None, None] * np.eye(periods)))
    gram, pull = weighted @ x, np.einsum("snt,st->sn", weighted, y - mu)
    alone = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2), 1e-300))
    taken = np.zeros(pull.shape, bool)

    def joint(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and z of the taken interventions of rows s; the others' are 0."""
        t = taken[s]
        inside = gram[s] * t[:, :, None] * t[:, None, :]
        inverse = np.linalg.pinv(inside, hermitian=True)
        size = np.einsum("snm,sm->sn", inverse, pull[s] * t)
        return size * t, np.where(t, size / np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2), 1e-300)), 0.0)

    live = np.arange(rows)
    for _ in range(2 * periods):
        if not len(live):
            break
        left = np.abs(pull[live] - np.einsum("snm,sm->sn", gram[live], joint(live)[0])) / alone[live]
        left[taken[live]] = 0
        best = left.argmax(axis=1)
        strong = left[np.arange(len(live)), best] >= critical
        live, best = live[strong], best[strong]
        taken[live, best] = True
    live = np.flatnonzero(taken.any(axis=1))
    while len(live):
        z = np.where(taken[live], np.abs(joint(live)[1]), np.inf)
        weak = z.argmin(axis=1)
        low = z[np.arange(len(live)), weak] < critical
        live, weak = live[low], weak[low]
        taken[live, weak] = False
        live = live[taken[live].any(axis=1)]
    found: list[list[tuple[str, int, float, float]]] = [[] for _ in range(rows)]
    live = np.flatnonzero(taken.any(axis=1))
    if len(live):
        size, z = joint(live)
        for s, n in zip(*np.nonzero(taken[live])):
            found[live[s]].append((*named[n], float(size[s, n]), float(z[s, n])))
    return found, critical


def attributed(series: DataFrame, *, unit: str = "u", window: tuple[int, int] | None = None, critical: float | None = None) -> DataFrame:
    """(unit, shape, effects, critical) of series (unit, at, y, mu, var: arrays; rho).

    The residual's covariance is sqrt(var_s * var_t) * rho ** |s - t|. effects: by falling z; relative: its size over
    mu at the beginning, or over the mean of mu from there on for what lasts. shape: the strongest rise that begins in
    ``window`` (periods, both included; anywhere without), or "none". A series of less than three periods has none.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for periods, part in frame.groupby(frame["at"].str.len()):
                y, mu, var, at = (np.stack(part[c].to_list()) for c in ("y", "mu", "var", "at"))
                if periods < 3:
                    found, need = [[]] * len(part), critical or 3.0
                else:
                    apart = np.abs(np.subtract.outer(np.arange(periods), np.arange(periods)))
                    sd = np.sqrt(np.maximum(var, 1e-12))
                    cov = sd[:, :, None] * sd[:, None, :] * part["rho"].to_numpy(float)[:, None, None] ** apart
                    found, need = interventions(y, mu, cov, critical)
                out = []
                for i, effects in enumerate(found):
                    made = []
                    for kind, t, size, z in effects:
                        base = mu[i, t:].mean() if kind in ("step", "trend") else mu[i, t]
                        made.append({"shape": kind, "start": int(at[i, t]), "z": z, "excess": size, "relative": size / max(base, 1e-12)})
                    made.sort(key=lambda e: (-e["z"], e["start"]))
                    rises = [e for e in made if e["z"] > 0 and (window is None or window[0] <= e["start"] <= window[1])]
                    out.append((rises[0]["shape"] if rises else "none", made))
                yield pd.DataFrame({unit: part[unit].to_list(), "shape": [o[0] for o in out], "effects": [o[1] for o in out], "critical": need})

    kind = dict(series.dtypes)[unit]
    return series.mapInPandas(work, f"{unit} {kind}, shape string, effects array<struct<shape:string,start:bigint,z:double,excess:double,relative:double>>, critical double")


def powers(at: np.ndarray, degree: int) -> np.ndarray:
    """For each row a design of powers of its standardised periods: rows x periods x (degree + 1)."""
    t = (at - at.mean(axis=1, keepdims=True)) / np.maximum(at.std(axis=1, keepdims=True), 1e-9)
    return t[:, :, None] ** np.arange(degree + 1)


def poisson_fit(obs: np.ndarray, exposure: np.ndarray, x: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-linear fits of all rows at once: coefficients, covariance (times the dispersion), means, dispersion (1 at least).

    x: rows x periods x terms, the first a constant. Rows with fewer than five events or a period without exposure are NaN.
    """
    fit = (obs.sum(axis=1) >= LEAST_EVENTS) & (exposure > 0).all(axis=1)
    y, e = np.where(fit[:, None], obs, 1.0), np.where(fit[:, None], exposure, 1.0)
    b = np.zeros((len(y), x.shape[2]))
    b[:, 0] = np.log(y.sum(axis=1) / e.sum(axis=1))
    tiny = 1e-9 * np.eye(x.shape[2])

    def state() -> tuple[np.ndarray, np.ndarray]:
        m = e * np.exp(np.clip(np.einsum("ntp,np->nt", x, b), -40, 40))
        return m, np.matmul(x.transpose(0, 2, 1) * m[:, None, :], x) + tiny

    for _ in range(rounds):
        m, info = state()
        move = np.linalg.solve(info, np.einsum("ntp,nt->np", x, y - m)[:, :, None])[:, :, 0]
        longest = np.abs(move).max(axis=1, initial=0, keepdims=True)
        b += move * np.minimum(1, 2 / np.maximum(longest, 1e-12))
        if longest.max(initial=0) < 1e-10:
            break
    m, info = state()
    dispersion = np.maximum(((y - m) ** 2 / m).sum(axis=1) / max(y.shape[1] - x.shape[2], 1), 1.0)
    cov = np.linalg.inv(info) * dispersion[:, None, None]
    b[~fit], cov[~fit] = np.nan, np.nan
    return b, cov, m, dispersion


def deviance(obs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Poisson deviance along the last axis."""
    share = np.where(obs > 0, obs / np.maximum(m, 1e-300), 1.0)
    return 2 * (obs * np.log(share) - (obs - m)).sum(axis=-1)


def best_break(obs: np.ndarray, exposure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The break (two periods at least on each side) of two levels with the least deviance, that deviance, and the later level over the earlier.

    All breaks are scored at once from running sums.
    """
    periods = obs.shape[1]
    cuts = np.arange(2, periods - 1)
    yb, eb = obs.cumsum(axis=1)[:, cuts - 1], exposure.cumsum(axis=1)[:, cuts - 1]
    ya, ea = obs.sum(axis=1, keepdims=True) - yb, exposure.sum(axis=1, keepdims=True) - eb
    before = np.arange(periods)[None, None, :] < cuts[None, :, None]
    level = np.where(before, (yb / np.maximum(eb, 1e-300))[:, :, None], (ya / np.maximum(ea, 1e-300))[:, :, None])
    dev = deviance(obs[:, None, :], exposure[:, None, :] * level)
    k = dev.argmin(axis=1)
    pick = lambda v: np.take_along_axis(v, k[:, None], axis=1)[:, 0]
    jump = (pick(ya) + 0.5) / (pick(yb) + 0.5) * pick(eb) / np.maximum(pick(ea), 1e-300)
    return cuts[k], pick(dev), jump


def shaped(series: DataFrame, *, unit: str = "u", gap: float = GAP) -> DataFrame:
    """(unit, slope, slope_se, dispersion, shape, gap, year, jump) of series (unit, at, y, exposure: arrays).

    slope: of log y / exposure per standard deviation of the periods. shape: "step" where the best break beats the better of
    a line and a parabola by ``gap`` in units of the dispersion, "gradual" where it loses by as much, else
    "indeterminate". year: the first period after the break. Series with fewer than five periods or events, or
    with a period without exposure, have nulls.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for periods, part in frame.groupby(frame["at"].str.len()):
                y, e, at = (np.stack(part[c].to_list()).astype(float) for c in ("y", "exposure", "at"))
                out = {unit: part[unit].to_list()}
                ok = (periods >= 5) & (y.sum(axis=1) >= LEAST_EVENTS) & (e > 0).all(axis=1)
                if periods < 5:
                    nothing = np.full(len(part), np.nan)
                    yield pd.DataFrame(out | {"slope": nothing, "slope_se": nothing, "dispersion": nothing, "shape": None, "gap": nothing, "year": pd.array([None] * len(part), "Int64"), "jump": nothing})
                    continue
                b, cov, line, spread = poisson_fit(y, e, powers(at, 1))
                smooth = np.minimum(deviance(y, line), deviance(y, poisson_fit(y, e, powers(at, 2))[2]))
                k, stepped, jump = best_break(y, e)
                lead = (smooth - stepped) / np.maximum(np.minimum(smooth, stepped) / max(periods - 4, 1), 1.0)
                blank = lambda v: np.where(ok, v, np.nan)
                shape = np.where(lead >= gap, "step", np.where(lead <= -gap, "gradual", "indeterminate"))
                out |= {"slope": b[:, 1], "slope_se": np.sqrt(cov[:, 1, 1]), "dispersion": blank(spread), "shape": np.where(ok, shape, None), "gap": blank(lead)}
                out |= {"year": pd.array(np.where(ok, at[np.arange(len(at)), k].astype("int64"), None), "Int64"), "jump": blank(jump)}
                yield pd.DataFrame(out)

    kind = dict(series.dtypes)[unit]
    return series.mapInPandas(work, f"{unit} {kind}, slope double, slope_se double, dispersion double, shape string, gap double, year bigint, jump double")


def slope_tail(slopes: DataFrame, *, least: float, rising: bool, freedom: int) -> DataFrame:
    """``slopes`` (slope, slope_se) with p: one-sided, that the slope goes beyond ``least`` that way (Student's t)."""

    @F.pandas_udf("double")
    def tail(b: pd.Series, se: pd.Series) -> pd.Series:
        t = ((1 if rising else -1) * b.to_numpy(float) - least) / se.to_numpy(float)
        half = d.beta_cdf(freedom / (freedom + np.nan_to_num(t) ** 2), freedom / 2, 0.5) / 2
        return pd.Series(np.where(np.isnan(t), np.nan, np.where(t > 0, half, 1 - half)))

    return slopes.withColumn("p", tail("slope", "slope_se"))


def profile_moved(claims: DataFrame, *, unit: str = "id", draws: int = 4000, alpha: float = 0.05) -> DataFrame:
    """(unit, n, llr, p_node, p_rest, result) of claims (unit, moved, node, rest: arrays over the same cells).

    Whose are the records that a pool lost: with the profile of ``node``, or the pool's own (``rest``)? Their log likelihood
    ratio is set against multinomial draws of both. "supports": the rest's profile is rejected and the node's isn't;
    "excluded": the other way round; "open": both, neither, or fewer than twenty moved. Profiles are counts; half a
    record is added to each cell. Draws depend on the claim's unit alone.
    """

    def one(key: object, moved: np.ndarray, node: np.ndarray, rest: np.ndarray) -> tuple:
        n = int(round(float(moved.sum())))
        if n < LEAST_MOVED:
            return n, None, None, None, "open"
        p, q = (node + 0.5) / (node + 0.5).sum(), (rest + 0.5) / (rest + 0.5).sum()
        w = np.log(p) - np.log(q)
        llr, rnd = float(moved @ w), np.random.default_rng(zlib.crc32(repr(key).encode()))
        as_rest = (1 + (rnd.multinomial(n, q, draws) @ w >= llr).sum()) / (1 + draws)
        as_node = (1 + (rnd.multinomial(n, p, draws) @ w <= llr).sum()) / (1 + draws)
        rest_out, node_out = as_rest < alpha, as_node < alpha
        return n, llr, float(as_node), float(as_rest), "open" if rest_out == node_out else "supports" if rest_out else "excluded"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(k, *(np.asarray(v, float) for v in arrays)) for k, *arrays in zip(f[unit], f["moved"], f["node"], f["rest"])]
            yield pd.DataFrame([(k, *g) for k, g in zip(f[unit], got)], columns=[unit, "n", "llr", "p_node", "p_rest", "result"])

    return claims.mapInPandas(work, f"{unit} {dict(claims.dtypes)[unit]}, n bigint, llr double, p_node double, p_rest double, result string")
