"""Places' own courses with shrinkage: level, slope and season of every place, how strongly each is shrunk learnt from all.

A place is one row that holds its periods as arrays; many places are fitted at once in a batch. Only sums over places
(three numbers a term) come back to the driver between rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweave.sources.scratch import staged

#: Strengths (inverse variances of a term over places) stay within these.
WEAKEST, STRONGEST = 1e-4, 1e8


def series(cells: DataFrame, values: list[str], *, unit: str = "u", at: str = "year") -> DataFrame:
    """(unit, at, values...): each unit's periods in order, as arrays of doubles; a period must not repeat within a unit."""
    rows = cells.groupBy(unit).agg(F.sort_array(F.collect_list(F.struct(F.col(at).cast("long").alias("_at"), *[F.col(v).cast("double").alias(v) for v in values]))).alias("_s"))
    return rows.select(unit, F.col("_s._at").alias("at"), *[F.col(f"_s.{v}").alias(v) for v in values])


def grid_of(cells: DataFrame, at: str) -> list[int]:
    """The periods in order; there are as many of them as the data's calendar has."""
    return sorted(r[0] for r in cells.select(F.col(at).cast("long")).distinct().collect())


def matrix(frame: pd.DataFrame, column: str, grid: np.ndarray, missing: float = 0.0) -> np.ndarray:
    """Arrays of a column as rows over the grid."""
    size = frame["at"].str.len().to_numpy(int)
    out = np.full((len(frame), len(grid)), missing)
    if size.sum():
        out[np.repeat(np.arange(len(frame)), size), np.searchsorted(grid, np.concatenate(frame["at"].to_list()))] = np.concatenate(frame[column].to_list())
    return out


def design(grid: list[int], terms: tuple[str, ...], *, base: list[int] | None = None, season: int = 12) -> np.ndarray:
    """A column for level, a column for slope (periods standardised by those of ``base``), two for season."""
    t, b = np.asarray(grid, float), np.asarray(grid if base is None else base, float)
    turn = 2 * np.pi * t / season
    made = {"level": [np.ones(len(t))], "slope": [(t - b.mean()) / max(b.std(), 1e-9)], "season": [np.sin(turn), np.cos(turn)]}
    return np.stack([c for term in terms for c in made[term]], axis=1)


def posterior(y: np.ndarray, mu: np.ndarray, phi: np.ndarray, x: np.ndarray, strength: np.ndarray, *, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Each row's most likely coefficients b of y ~ NB(mu * exp(x b), phi) with b ~ N(0, 1 / strength), and their covariance.

    Scoring steps on all rows at once; a row's step is shortened to two where it is longer. Periods with mu = 0 say nothing.
    """
    spread = np.where(np.isfinite(phi) & (phi > 0), 1 / np.where(phi > 0, phi, 1.0), 0.0)
    b = np.zeros((len(y), x.shape[1]))
    prior = np.diag(strength)

    def information(m: np.ndarray) -> np.ndarray:
        return np.matmul(x.T[None] * (m / (1 + m * spread))[:, None, :], x) + prior

    for _ in range(rounds):
        m = mu * np.exp(np.clip(b @ x.T, -40, 40))
        slope = ((y - m) * (mu > 0) / (1 + m * spread)) @ x - b * strength
        move = np.linalg.solve(information(m), slope[:, :, None])[:, :, 0]
        longest = np.abs(move).max(axis=1, initial=0, keepdims=True)
        b += move * np.minimum(1, 2 / np.maximum(longest, 1e-12))
        if longest.max(initial=0) < 1e-9:
            break
    return b, np.linalg.inv(information(mu * np.exp(np.clip(b @ x.T, -40, 40))))


def place_courses(
    cells: DataFrame,
    *,
    unit: str = "u",
    at: str = "year",
    terms: tuple[str, ...] = ("level", "slope"),
    season: int = 12,
    strength: list[float] | None = None,
    ahead: tuple[int, ...] = (),
    damping: float = 0.5,
    most_rounds: int = 30,
) -> DataFrame:
    """One row for each place of ``cells`` (unit, at, y, mu, phi) with its course around mu and how sure it is.

    coef, sd, cov: of the terms (slope in standard deviations of the periods); strength: their common inverse
    variances, learnt from all places unless given; at, fitted, eta_var: mu times the course in each period and the variance
    of its logarithm; ahead, shift, shift_var: the course's logarithm in later periods, its slope ``damping`` times as
    steep, and the variance of the undamped one.

    Strengths are learnt in rounds (Fellner and Schall): the number of places less the prior's part of their variances,
    over the sum of squares, until none changes by a hundredth. Places without any expectation keep coefficients of 0
    and don't count. A missing period says nothing.
    """
    grid = grid_of(cells, at)
    table = staged(series(cells, ["y", "mu", "phi"], unit=unit, at=at), "courses")
    axis, x = np.array(grid), design(grid, terms, season=season)
    new = design(list(ahead), terms, base=grid, season=season) if ahead else np.zeros((0, x.shape[1]))
    slow = new.copy()
    names = [t for t in terms for _ in range(2 if t == "season" else 1)]
    slow[:, [n == "slope" for n in names]] *= damping
    size = len(names)

    def fitted(frame: pd.DataFrame, tau: np.ndarray) -> tuple[np.ndarray, ...]:
        y, mu, phi = (matrix(frame, c, axis) for c in ("y", "mu", "phi"))
        return mu, *posterior(y, mu, phi, x, tau)

    def sums(tau: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    mu, b, cov = fitted(frame, tau)
                    live = mu.sum(axis=1) > 0
                    yield pd.DataFrame({"term": np.arange(size), "places": float(live.sum()), "square": (b[live] ** 2).sum(axis=0), "trace": np.diagonal(cov[live], axis1=1, axis2=2).sum(axis=0)})

        return work

    tau = np.array(strength, float) if strength is not None else np.ones(size)
    for _ in range(0 if strength is not None else most_rounds):
        per = table.mapInPandas(sums(tau), "term int, places double, square double, trace double").groupBy("term").agg(F.sum("places"), F.sum("square"), F.sum("trace"))
        got = np.array([list(r)[1:] for r in sorted(per.collect(), key=lambda r: r[0])])
        if not len(got):
            break
        before, tau = tau, np.clip((got[:, 0] - tau * got[:, 2]) / np.maximum(got[:, 1], 1e-12), WEAKEST, STRONGEST)
        if np.abs(np.log(tau / before)).max() < 0.01:
            break

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            mu, b, cov = fitted(frame, tau)
            var = lambda z: np.einsum("ti,uij,tj->ut", z, cov, z)
            here = [np.searchsorted(axis, a) for a in frame["at"]]
            whole, sure = mu * np.exp(b @ x.T), var(x)
            yield pd.DataFrame(
                {
                    unit: frame[unit],
                    "coef": list(b),
                    "sd": list(np.sqrt(np.diagonal(cov, axis1=1, axis2=2))),
                    "cov": [list(c) for c in cov],
                    "at": frame["at"],
                    "fitted": [f[i] for f, i in zip(whole, here)],
                    "eta_var": [v[i] for v, i in zip(sure, here)],
                    "shift": list(b @ slow.T),
                    "shift_var": list(var(new)),
                }
            )

    kind = dict(table.dtypes)[unit]
    out = table.mapInPandas(work, f"{unit} {kind}, coef array<double>, sd array<double>, cov array<array<double>>, at array<bigint>, fitted array<double>, eta_var array<double>, shift array<double>, shift_var array<double>")
    many = lambda v, t: F.array(*[F.lit(c) for c in v]).cast(f"array<{t}>")
    return out.select(unit, "coef", "sd", "cov", many(tau.tolist(), "double").alias("strength"), "at", "fitted", "eta_var", many(ahead, "bigint").alias("ahead"), "shift", "shift_var")


def by_period(courses: DataFrame, *, unit: str = "u", later: bool = False) -> DataFrame:
    """(unit, at, mu, eta_var) of the fitted periods, or (unit, at, shift, shift_var) of later ones: a row for each."""
    cols = ("ahead", "shift", "shift_var") if later else ("at", "fitted", "eta_var")
    rows = courses.select(unit, F.explode(F.arrays_zip(*cols)).alias("_p"))
    return rows.select(unit, *[F.col(f"_p.{c}").alias(n) for c, n in zip(cols, ("at", "shift" if later else "mu", "shift_var" if later else "eta_var"))])
