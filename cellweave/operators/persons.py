"""Persons across linked records, capture-recapture, cohort regressions."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweave.functions import distributions as d
from cellweave.operators.graphs import components
from cellweave.sources.scratch import staged


def persons(records: DataFrame, pairs: DataFrame, *, least: float = 0.5, draw: int | None = None) -> DataFrame:
    """(id, entity): records merged across links. pairs: l, r, p_match.

    Links count from ``least`` on; with ``draw`` each counts with its probability, by a hash of the pair and the draw.
    """
    if draw is None:
        kept = pairs.where(F.col("p_match") >= least)
    else:
        u = F.pmod(F.xxhash64("l", "r", F.lit(draw)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        kept = pairs.where(u < F.col("p_match"))
    comp = components(kept.select(F.col("l").alias("a"), F.col("r").alias("b")))
    return records.select("id").distinct().join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("entity"))


def capture_patterns(flags: DataFrame, systems: list[str]) -> DataFrame:
    """How many persons each combination of systems holds; those in none aren't seen."""
    rows = flags.groupBy(*systems).agg(F.count("*").alias("n"))
    return rows.where(" or ".join(f"{s} = 1" for s in systems))


def log_linear(design: np.ndarray, counts: np.ndarray, *, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Poisson regression: coefficients, their covariance and the log likelihood; None if the design doesn't identify them."""
    if design.shape[1] > len(counts) or np.linalg.matrix_rank(design) < design.shape[1]:
        return None
    eta = np.log(counts + 0.5)
    for _ in range(rounds):
        mu = np.exp(np.clip(eta, -30, 30))
        target = eta + (counts - mu) / mu
        root = np.sqrt(mu)
        beta = np.linalg.lstsq(design * root[:, None], target * root, rcond=None)[0]
        new = design @ beta
        done = np.abs(new - eta).max() < 1e-9
        eta = new
        if done:
            break
    mu = np.exp(np.clip(eta, -30, 30))
    information = (design.T * mu) @ design
    if not np.isfinite(information).all() or np.linalg.cond(information) > 1e12:  # an effect that runs off to infinity
        return None
    return beta, np.linalg.inv(information), float((counts * np.log(mu) - mu - d.lgamma(counts + 1)).sum())


def multiple_systems(patterns: DataFrame, systems: list[str]) -> tuple[float, float]:
    """Estimated total and its standard deviation from counts by pattern of systems: a mean over log-linear models.

    A model has the systems' own effects and any set of effects of pairs; those that the patterns don't identify are
    passed over. Models weigh exp(-AIC / 2); the deviation holds each model's own and the spread between models.
    Patterns that no person shows count zero. There are 2 ** systems - 1 patterns, whatever the number of persons.
    """
    seen = {tuple(int(r[s]) for s in systems): float(r["n"]) for r in patterns.collect()}
    cells = [c for c in product((0, 1), repeat=len(systems)) if any(c)]
    counts, main = np.array([seen.get(c, 0.0) for c in cells]), np.array(cells, float)
    both = np.array([[c[i] * c[j] for i, j in combinations(range(len(systems)), 2)] for c in cells], float).reshape(len(cells), -1)
    fitted = []
    for chosen in product((False, True), repeat=both.shape[1]):
        design = np.hstack([np.ones((len(cells), 1)), main, both[:, np.array(chosen, bool)]])
        if (found := log_linear(design, counts)) is not None:
            beta, covariance, likelihood = found
            hidden = float(np.exp(beta[0]))
            fitted.append((2 * design.shape[1] - 2 * likelihood, hidden, hidden * float(np.sqrt(covariance[0, 0]))))
    if not fitted:
        raise ValueError("no model is identified by these patterns")
    aic, hidden, own = np.array(fitted).T
    weight = np.exp((aic.min() - aic) / 2)
    weight /= weight.sum()
    mean = float(weight @ hidden)
    return float(counts.sum()) + mean, float(weight @ np.hypot(own, hidden - mean))


def cohort_fit(table: DataFrame, attributes: list[str], *, outcome: str = "y", person_time: str = "t", place: str = "u", rounds: int = 8, prior: float = 1.0) -> pd.DataFrame:
    """Log rate ratios of 0/1 attributes by Poisson regression with a shrunk effect of each place.

    Alternates closed-form place effects (gamma-Poisson, a sum per place) with a Newton step whose normal equations
    Spark sums; nothing but those sums reaches the driver.
    """
    k = len(attributes)
    beta = np.zeros(k + 1)
    names = ["_one", *attributes]
    base = staged(table.withColumn("_one", F.lit(1.0)), "cohort")
    for _ in range(rounds):
        eta = sum((F.lit(float(b)) * F.col(n) for b, n in zip(beta, names)), F.lit(0.0))
        mu = F.col(person_time) * F.exp(eta)
        effect = base.groupBy(place).agg(((F.sum(outcome) + prior) / (F.sum(mu) + prior)).alias("_e"))
        rows = base.join(effect, place)
        mu = mu * F.col("_e")
        sums = [F.sum((F.col(outcome) - mu) * F.col(n)) for n in names] + [F.sum(mu * F.col(names[i]) * F.col(names[j])) for i in range(k + 1) for j in range(i, k + 1)]
        got = np.array(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first(), float)
        h = np.zeros((k + 1, k + 1))
        h[np.triu_indices(k + 1)] = got[k + 1 :]
        h = h + np.triu(h, 1).T + 1e-9 * np.eye(k + 1)
        step = np.linalg.solve(h, got[: k + 1])
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    sd = np.sqrt(np.diag(np.linalg.inv(h)))
    z = (np.abs(beta) - np.log(1.2)) / sd
    return pd.DataFrame({"attribute": ["intercept", *attributes], "log_rr": beta, "sd": sd, "p": np.where(z > 0, 2 * d.normal_sf(z), 1.0)})


def over_draws(estimates: list[tuple[float, float]]) -> tuple[float, float]:
    """Rubin's rule: mean of estimates over link draws, and sd from within and between variance."""
    m = np.array([e for e, _ in estimates])
    v = np.array([s**2 for _, s in estimates])
    return float(m.mean()), float(np.sqrt(v.mean() + (1 + 1 / len(m)) * (m.var(ddof=1) if len(m) > 1 else 0)))
