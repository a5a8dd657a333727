"""Relations between series: correlations over places and lags, factors, and Poisson factorisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def lagged(series: DataFrame, lags: int, *, keys: tuple[str, ...] = ("field", "u"), value: str = "x") -> DataFrame:
    """(keys, year, lag, x): each value again for every lag, at the year in which it is seen."""
    rows = series.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags))))
    return rows.select(*keys, (F.col("year") + F.col("lag")).alias("year"), "lag", value)


def weighted_correlations(series: DataFrame, *, lags: int = 0, spread: int = 16) -> DataFrame:
    """All pairs of fields, one led by 0 to ``lags`` years: weighted correlation over places and years, and Kish size.

    series: field, u, year, x, w. Fields of one place and year meet as columns of a row, and only their products are
    summed, in two stages (a part of the places, then all), so no field or place is gathered anywhere.
    """
    base = series.select("field", "u", "year", "x", "w")
    led = base.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).select(F.col("field").alias("leader"), "u", (F.col("year") + F.col("lag")).alias("year"), "lag", F.col("x").alias("xl"), F.col("w").alias("wl"))
    met = base.join(led, ["u", "year"]).where((F.col("field") != F.col("leader")) & ((F.col("lag") > 0) | (F.col("field") > F.col("leader"))))
    w = F.sqrt(F.col("w") * F.col("wl"))
    part = met.withColumn("part", F.pmod(F.xxhash64("u"), F.lit(spread))).groupBy("field", "leader", "lag", "part")
    x, y = F.col("x"), F.col("xl")
    sums = {"n": F.sum(w), "nn": F.sum(w * w), "sx": F.sum(w * x), "sy": F.sum(w * y), "sxx": F.sum(w * x * x), "syy": F.sum(w * y * y), "sxy": F.sum(w * x * y)}
    total = part.agg(*[v.alias(k) for k, v in sums.items()]).groupBy("field", "leader", "lag").agg(*[F.sum(k).alias(k) for k in sums])
    n = F.col("n")
    cov = F.col("sxy") / n - F.col("sx") * F.col("sy") / n**2
    var = (F.col("sxx") / n - (F.col("sx") / n) ** 2) * (F.col("syy") / n - (F.col("sy") / n) ** 2)
    return total.select("field", "leader", "lag", (cov / F.sqrt(var)).alias("rho"), (n**2 / F.col("nn")).alias("n_eff"))


def pair_test(pairs: DataFrame, *, delta: float) -> DataFrame:
    """z of the correlation beyond ``delta``: (atanh |rho| - atanh delta) sqrt(n_eff - 3), and its one-sided p doubled."""
    from cellweave.functions.tails import normal_two_sided

    at = lambda x: F.log((1 + x) / (1 - x)) / 2
    z = (at(F.least(F.abs("rho"), F.lit(1 - 1e-12))) - at(F.lit(delta))) * F.sqrt(F.greatest(F.col("n_eff") - 3, F.lit(0.0)))
    rows = pairs.withColumn("z", z)
    return rows.withColumn("_t", normal_two_sided("z")).withColumn("p", F.when(F.col("z") > 0, F.col("_t")).otherwise(F.lit(1.0))).drop("_t")


def prewhitened(series: DataFrame) -> DataFrame:
    """Each field-place series less its first-order autoregression (the field's pooled coefficient)."""
    w = W.partitionBy("field", "u").orderBy("year")
    rows = series.withColumns({"_y": F.lag("year").over(w), "_x": F.lag("x").over(w)}).where("year = _y + 1")
    a = rows.groupBy("field").agg((F.sum(F.col("x") * F.col("_x")) / F.sum(F.col("_x") ** 2)).alias("a"))
    return rows.join(a, "field").select("field", "u", "year", (F.col("x") - F.col("a") * F.col("_x")).alias("x"), "w")


def correlation_matrix(pairs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Fields and their matrix at lag 0: a number for each pair of declared fields, whatever the number of records."""
    rows = pairs.where("lag = 0").select("field", "leader", "rho").collect()
    names = sorted({r.field for r in rows} | {r.leader for r in rows})
    at = {f: i for i, f in enumerate(names)}
    m = np.eye(len(names))
    for r in rows:
        m[at[r.field], at[r.leader]] = m[at[r.leader], at[r.field]] = r.rho or 0.0
    return names, m


def factors(pairs: DataFrame, k: int, *, rounds: int = 200) -> pd.DataFrame:
    """Principal-factor loadings of the fields, communalities iterated; signs make each factor's largest loading positive."""
    names, m = correlation_matrix(pairs)
    h = np.full(len(names), 0.5)
    load = np.zeros((len(names), k))
    for _ in range(rounds):
        r = m.copy()
        np.fill_diagonal(r, h)
        value, vector = np.linalg.eigh(r)
        top = np.argsort(-value)[:k]
        load = vector[:, top] * np.sqrt(np.maximum(value[top], 0))
        new = np.clip((load**2).sum(1), 0, 0.999)
        if np.abs(new - h).max() < 1e-9:
            break
        h = new
    load *= np.sign(load[np.abs(load).argmax(0), np.arange(k)])
    return pd.DataFrame(load, index=names)


def poisson_factors(cells: DataFrame, rank: int, *, rounds: int = 500, tol: float = 1e-6, seed: str = "factors") -> tuple[DataFrame, DataFrame]:
    """Non-negative Poisson factorisation y ~ mu * sum_k a_uk b_tk, component 0 held constant.

    cells: u, year, y, mu. A place is a row with its years as columns. In a round each task fits its places' a to the
    b of the round (a concave problem of each place alone, so places keep no state) and sums the gradient and curvature
    of the deviance that remains once a follows b. The driver takes a Newton step in log b from these sums, as many as
    there are years and components; a step after which the deviance has risen is shortened. Rounds end when a step
    promises or gains less than ``tol`` of the deviance. b is at most 1 in each component, the size is in a.
    """
    from cellweave.operators.expectation import uniform
    from cellweave.sources.scratch import staged

    spark = cells.sparkSession
    years = sorted(r["year"] for r in cells.select("year").distinct().collect())
    n = len(years)
    free = n * rank
    wide = staged(cells.groupBy("u").pivot("year", years).agg(F.sum("y").cast("double").alias("y"), F.sum("mu").cast("double").alias("mu")).fillna(0.0), "factors")
    start = spark.createDataFrame([(i, k) for i in range(n) for k in range(1, rank + 1)], "i int, k int").withColumn("b", 0.1 + 0.1 * uniform("i", "k", seed=seed)).collect() if free else []
    b = np.ones((n, rank + 1))
    for r in start:
        b[r["i"], r["k"]] = r["b"]

    def fitted(f: pd.DataFrame, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = f.iloc[:, 1:].to_numpy(float)
        y, mu = x[:, 0::2], x[:, 1::2]
        a = np.ones((len(x), b.shape[1]))
        a[:, 1:] = 0.15
        size = np.maximum(mu @ b, 1e-12)
        for _ in range(200):
            m = np.maximum(a @ b.T, 1e-12)
            new = a * ((y / m) @ b) / size
            if rank:  # a Newton step for every place that it leaves positive, else the multiplicative one
                curve = np.einsum("ut,tj,tk->ujk", y / (m * m), b[:, 1:], b[:, 1:]) + 1e-9 * np.eye(rank)
                step = a[:, 1:] + np.linalg.solve(curve, ((y / m) @ b - size)[:, 1:, None])[..., 0]
                if rank == 1:  # a step that is too long only leads below the solution, from where the next ones rise to it
                    step = np.maximum(step, 0.05 * a[:, 1:])
                fine = (step > 0.01 * a[:, 1:]).all(1)
                new[fine, 1:] = step[fine]
            new[:, 0] = 1
            done = not len(a) or np.abs(new - a).max() < 1e-10 * max(1.0, a.max())
            a = new
            if done:
                break
        return y, mu, a

    def sums(batches, b):
        for batch in batches:
            for at in range(0, len(batch), 1000):
                y, mu, a = fitted(batch.iloc[at : at + 1000], b)
                m = np.maximum(a @ b.T, 1e-12)
                dev = 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1e-12) / np.maximum(mu * m, 1e-12)), 0) - (y - mu * m)).sum()
                rest, weight, own, at_year = y / m - mu, y / (m * m), a[:, 1:], b[:, 1:]
                curve = np.zeros((n, rank, n, rank))
                curve[np.arange(n), :, np.arange(n), :] = np.einsum("ut,uj,uk->tjk", weight, own, own)
                # how a place's a answers to b; what is at its bound of 0 doesn't
                mixed = np.einsum("ut,tj,uk->ujtk", weight, at_year, own) - np.einsum("ut,jk->ujtk", rest, np.eye(rank))
                inner = np.einsum("ut,tj,tk->ujk", weight, at_year, at_year)
                still = own < 1e-8
                mixed[still] = 0
                inner[still] = 0
                inner.transpose(0, 2, 1)[still] = 0
                inner += np.einsum("uj,jk->ujk", np.where(still, 1.0, 1e-9), np.eye(rank))
                flat = mixed.reshape(len(y), rank, free)
                curve = curve.reshape(free, free) - np.einsum("ujx,ujy->xy", flat, np.linalg.solve(inner, flat))
                yield pd.DataFrame({"i": np.arange(free), "slope": (rest.T @ own).ravel(), "curve": list(curve), "dev": np.full(free, dev)})

    before, best, step = np.inf, np.log(b[:, 1:].ravel()), np.zeros(free)
    for _ in range(rounds if free else 0):
        now = best + step
        b[:, 1:] = np.exp(now).reshape(n, rank)
        added = F.array(*[F.sum(F.col("curve")[j]) for j in range(free)]).alias("curve")
        rows = wide.mapInPandas(lambda batches, b=b.copy(): sums(batches, b), "i int, slope double, curve array<double>, dev double")
        rows = rows.groupBy("i").agg(F.sum("slope").alias("slope"), added, F.sum("dev").alias("dev")).toPandas().sort_values("i")  # years times components
        if not len(rows):
            break
        dev = rows["dev"].iloc[0]
        if dev > before + 1e-9 * max(abs(before), 1.0):
            step = step / 4
            if np.abs(step).max() < 1e-6:
                break
            continue
        gained, before, best, at = before - dev, dev, now, np.exp(now)
        if gained < tol * max(abs(dev), 1.0):
            break
        slope = rows["slope"].to_numpy() * at
        value, vector = np.linalg.eigh(np.stack(rows["curve"]) * np.outer(at, at) + np.diag(np.maximum(-slope, 0)))
        value = np.maximum(np.abs(value), 1e-6 * np.abs(value).max() + 1e-12)
        step = vector @ ((vector.T @ slope) / value)
        step *= min(1.0, 1.5 / max(np.abs(step).max(), 1e-12))
        if slope @ step < tol * max(abs(dev), 1.0):
            break
    b[:, 1:] = np.exp(best).reshape(n, rank)
    b = b / np.maximum(b.max(0), 1e-12) if n else b

    def last(batches):
        for f in batches:
            a = fitted(f, b)[2]
            yield pd.DataFrame({"u": np.repeat(f.iloc[:, 0].to_numpy(), rank + 1), "k": np.tile(np.arange(rank + 1), len(f)), "a": a.ravel()})

    a = wide.mapInPandas(last, f"u {dict(cells.dtypes)['u']}, k int, a double")
    at = spark.createDataFrame([(t, k, float(b[i, k])) for i, t in enumerate(years) for k in range(rank + 1)], f"year {dict(cells.dtypes)['year']}, k int, b double")
    return a, at


def rank_correlation(rows: DataFrame, x: str, y: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Spearman's correlation with average ranks, per group."""
    fam = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))

    def rank(c: str) -> Column:
        return F.rank().over(fam.orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c) if by else W.partitionBy(c)) - 1) / 2

    return rows.withColumns({"_rx": rank(x), "_ry": rank(y)}).groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def normal_scores(rows: DataFrame, x: str, *, by: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``score``: the normal quantile of rank / (n + 1)."""
    from pyspark.sql.functions import pandas_udf

    from cellweave.functions import distributions as d

    @pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return pd.Series(-d.normal_isf(p.to_numpy(float)))

    fam = W.partitionBy(*by)
    share = F.rank().over(fam.orderBy(x)) / (F.count("*").over(fam) + 1)
    return rows.withColumn("_q", share).withColumn("score", quantile("_q")).drop("_q")


def distributed_lag(series: DataFrame, max_lag: int, *, penalty: float = 1.0) -> DataFrame:
    """Effects beta_l of an exposure's lags on log(y / mu): penalised Poisson regression, second differences of beta penalised.

    series: u, year, y, mu, x. Spark sums the normal equations (max_lag + 1 squared numbers); Newton steps solve them.
    """
    lags = [f"x{l}" for l in range(max_lag + 1)]
    w = W.partitionBy("u").orderBy("year")
    rows = series
    for l, name in enumerate(lags):
        rows = rows.withColumn(name, F.lag("x", l).over(w))
    rows = rows.where(F.col(lags[-1]).isNotNull())
    k = max_lag + 1
    diff = np.diff(np.eye(k), 2, axis=0)
    ridge = penalty * diff.T @ diff + 1e-6 * np.eye(k)
    beta = np.zeros(k)
    for _ in range(12):
        eta = sum((F.lit(float(b)) * F.col(n) for b, n in zip(beta, lags)), F.lit(0.0))
        m = F.col("mu") * F.exp(F.least(F.greatest(eta, F.lit(-20.0)), F.lit(20.0)))
        sums = [F.sum((F.col("y") - m) * F.col(n)) for n in lags] + [F.sum(m * F.col(lags[i]) * F.col(lags[j])) for i in range(k) for j in range(i, k)]
        got = np.array(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first(), float)
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = got[k:]
        h = h + np.triu(h, 1).T
        step = np.linalg.solve(h + ridge, got[:k] - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    sd = np.sqrt(np.diag(np.linalg.inv(h + ridge)))
    return series.sparkSession.createDataFrame([(l, float(b), float(s)) for l, (b, s) in enumerate(zip(beta, sd))], "lag int, beta double, sd double")
