"""Expectations fitted by group, place and year; tiers with place terms; dispersion by likelihood; held-out scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.functions import distributions as d
from cellweave.sources.scratch import staged


def _scaled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """mu times the factor that makes its sum over ``keys`` that of y."""
    w = W.partitionBy(*keys)
    fitted = F.sum("mu").over(w)
    return rows.withColumn("mu", F.when(fitted > 0, F.col("mu") * F.sum("y").over(w) / fitted).otherwise(F.lit(0.0)))


def place_effects(rows: DataFrame, *, unit: str = "u") -> DataFrame:
    """(unit, effect): (Y + a) / (M + a) with 1 / a the spread of places' ratios beyond chance, by moments."""
    per = rows.groupBy(unit).agg(F.sum("y").alias("_y"), F.sum("mu").alias("_m"))
    s = per.agg(F.sum((F.col("_y") - F.col("_m")) ** 2 / F.col("_m") - 1).alias("_over"), F.sum("_m").alias("_all"))
    a = F.col("_all") / F.greatest(F.col("_over"), F.lit(1e-9))
    return per.crossJoin(s).select(unit, ((F.col("_y") + a) / (F.col("_m") + a)).alias("effect"))  # s is one row


def fit(cells: DataFrame, margins: list[list[str]], *, rounds: int = 3, unit: str = "u") -> DataFrame:
    """``cells`` (unit, margins' keys, y, n) with mu: exposure times a factor for every margin and a shrunk effect of each place.

    A round scales mu to every margin, then multiplies by the places' effects on what the margins leave; the effects'
    strength is estimated anew in each round. Every step is a sum over the cell table.
    """
    rows = cells.withColumn("mu", F.col("n").cast("double"))
    for _ in range(rounds):
        for keys in margins:
            rows = _scaled(rows, keys)
        rows = staged(rows, "fit")
        effect = place_effects(rows, unit=unit)
        rows = rows.join(effect, unit).withColumn("mu", F.col("mu") * F.col("effect")).drop("effect")
    for keys in margins:
        rows = _scaled(rows, keys)
    return staged(rows, "fit")


def without(cells: DataFrame, inside: Column, *, period: str = "year") -> DataFrame:
    """``cells`` (period, y, n) with mu from the rates of the cells outside a locus alone."""
    out = F.when(inside, 0.0).otherwise(1.0)
    w = W.partitionBy(period)
    return cells.withColumn("mu", F.col("n") * F.sum(out * F.col("y")).over(w) / F.sum(out * F.col("n")).over(w))


def exposure_variance(cells: DataFrame, *, by: tuple[str, ...], sd: float, rho: float) -> DataFrame:
    """Variance of a sum of expectations whose log exposures have this standard deviation and correlation."""
    part = F.col("mu") * sd
    per = cells.groupBy(*by).agg(F.sum("mu").alias("mu"), F.sum(part * part).alias("_own"), F.sum(part).alias("_all"))
    return per.select(*by, "mu", ((1 - rho) * F.col("_own") + rho * F.col("_all") ** 2).alias("variance"))


def predictive_phi(mu: Column, variance: Column, phi: Column) -> Column:
    """The dispersion of a count whose expectation is itself uncertain: 1 / phi' = 1 / phi + variance / mu**2."""
    return 1 / (1 / phi + variance / (mu * mu))


def dispersion_by(cells: DataFrame, by: str) -> DataFrame:
    """phi by moments in each group, shrunk to that of all cells: the groups' excess spreads count with their cells."""
    over, base = (F.col("y") - F.col("mu")) ** 2 - F.col("mu"), F.col("mu") ** 2
    per = cells.groupBy(by).agg(F.sum(over).alias("_o"), F.sum(base).alias("_b"), F.count("*").alias("cells"))
    every = per.agg((F.sum("_o") / F.sum("_b")).alias("_all"))
    alpha = (F.col("cells") * F.col("_o") / F.col("_b") + 10 * F.col("_all")) / (F.col("cells") + 10)
    return per.crossJoin(every).select(by, "cells", (1 / F.greatest(alpha, F.lit(1e-9))).alias("phi"))  # every is one row


def dispersion_power(cells: DataFrame) -> DataFrame:
    """Variance mu + c mu**power: the line of log((y - mu)**2 - mu) on log mu over cells with excess spread."""
    over = (F.col("y") - F.col("mu")) ** 2 - F.col("mu")
    rows = cells.where((F.col("mu") > 0) & (over > 0)).select(F.log("mu").alias("x"), F.log(over).alias("v"))
    return rows.agg(F.regr_slope("v", "x").alias("power"), F.exp(F.regr_intercept("v", "x")).alias("c"), F.count("*").alias("cells"))


def binned_likelihood(cells: DataFrame, phis: list[float], *, digits: int = 2) -> DataFrame:
    """(phi, loglik): negative binomial likelihood of all cells for each phi, from counts of cells by y and rounded log mu.

    What is evaluated has a row for each y and bin, whatever the number of cells.
    """
    bins = cells.where("mu > 0").groupBy("y", F.round(F.log("mu"), digits).alias("m")).agg(F.count("*").alias("k"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            y, mu, k = f["y"].to_numpy(float), np.exp(f["m"].to_numpy(float)), f["k"].to_numpy(float)
            yield pd.DataFrame({"phi": phis, "part": [float((k * d.nb_logpmf(y, mu, phi)).sum()) for phi in phis]})

    return bins.mapInPandas(each, "phi double, part double").groupBy("phi").agg(F.sum("part").alias("loglik"))


def heldout(train: DataFrame, test: DataFrame) -> DataFrame:
    """Deviance of later cells under a constant rate, with and without the places' shrunk effects. Both: u, y, n."""
    rate = train.agg((F.sum("y") / F.sum("n")).alias("_r"))
    fitted = train.crossJoin(rate).withColumn("mu", F.col("n") * F.col("_r"))  # one row
    rows = test.crossJoin(rate).withColumn("mu0", F.col("n") * F.col("_r")).join(place_effects(fitted), "u", "left")  # one row
    rows = rows.withColumn("mu1", F.col("mu0") * F.coalesce("effect", F.lit(1.0)))
    dev = lambda m: 2 * F.sum(F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / F.col(m))).otherwise(0.0) - (F.col("y") - F.col(m)))
    return rows.agg(dev("mu0").alias("level"), dev("mu1").alias("places"), F.count("*").alias("cells"))


def prospective(cells: DataFrame, last: int) -> DataFrame:
    """Later years' expectations from the years up to ``last``: bp at the rates known then, bpa at each year's own level.

    cells: u, year, y, n. Both have the places' effects of the training years.
    """
    known = cells.where(F.col("year") <= last)
    rate = known.agg((F.sum("y") / F.sum("n")).alias("_r"))
    effect = place_effects(known.crossJoin(rate).withColumn("mu", F.col("n") * F.col("_r")))  # one row
    rows = cells.where(F.col("year") > last).crossJoin(rate).join(effect, "u")  # one row
    rows = rows.withColumn("bp", F.col("n") * F.col("_r") * F.col("effect"))
    w = W.partitionBy("year")
    return rows.withColumn("bpa", F.col("bp") * F.sum("y").over(w) / F.sum("bp").over(w)).select("u", "year", "y", "bp", "bpa")


def refit_places(cells: DataFrame, *, tau: float = 1.0, rounds: int = 8) -> DataFrame:
    """Each place's log level under a normal prior of variance tau: Newton steps on its negative binomial likelihood.

    cells: u, year, y, mu, phi. A place's series is its own problem; places are fitted side by side.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        y, mu, phi = (frame[c].to_numpy(float) for c in ("y", "mu", "phi"))
        b = 0.0
        for _ in range(rounds):
            m = mu * np.exp(b)
            w = 1 / (1 + m / phi)
            b += ((w * (y - m)).sum() - b / tau) / ((w * m).sum() + 1 / tau)
        return pd.DataFrame({"u": [frame["u"].iat[0]], "level": [b]})

    return cells.groupBy("u").applyInPandas(one, f"u {dict(cells.dtypes)['u']}, level double")


def ridge_places(cells: DataFrame, *, penalty: float = 1.0) -> DataFrame:
    """Each place's level and yearly slope of log((y + 1/2) / (mu + 1/2)), weighted by mu / (1 + mu / phi), both shrunk.

    cells: u, year, y, mu, phi. Years are counted from the middle of the place's own.
    """
    w = F.col("mu") / (1 + F.col("mu") / F.col("phi"))
    t = F.col("year") - (F.min("year").over(W.partitionBy("u")) + F.max("year").over(W.partitionBy("u"))) / 2
    rows = cells.select("u", w.alias("w"), t.alias("t"), F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("r"))
    s = rows.groupBy("u").agg((F.sum("w") + penalty).alias("a"), F.sum(F.col("w") * F.col("t")).alias("b"), (F.sum(F.col("w") * F.col("t") ** 2) + penalty).alias("c"), F.sum(F.col("w") * F.col("r")).alias("p"), F.sum(F.col("w") * F.col("t") * F.col("r")).alias("q"))
    det = F.col("a") * F.col("c") - F.col("b") ** 2
    return s.select("u", ((F.col("c") * F.col("p") - F.col("b") * F.col("q")) / det).alias("level"), ((F.col("a") * F.col("q") - F.col("b") * F.col("p")) / det).alias("slope"))


def season_places(cells: DataFrame, *, penalty: float = 1.0) -> DataFrame:
    """Each place's yearly sine and cosine of log((y + 1/2) / (mu + 1/2)) over months, weighted by mu and shrunk. cells: u, month, y, mu."""
    angle = F.lit(2 * np.pi) * (F.col("month") - 1) / 12
    r, w = F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)), F.col("mu")
    s, c = F.sin(angle), F.cos(angle)
    return cells.groupBy("u").agg((F.sum(w * r * s) / (F.sum(w * s * s) + penalty)).alias("sin"), (F.sum(w * r * c) / (F.sum(w * c * c) + penalty)).alias("cos"))


def member_weights(series: DataFrame, last: int) -> DataFrame:
    """Weights of the rules linear, damped and flat by their squared error at ``last``, from the years before. series: u, t, x."""
    past = series.where(F.col("t") < last)
    per = past.groupBy("u").agg(F.max_by("x", "t").alias("level"), F.regr_slope("x", "t").alias("slope"), F.avg("x").alias("flat"))
    rows = per.join(series.where(F.col("t") == last).select("u", "x"), "u")
    e = rows.agg(F.avg((F.col("x") - F.col("level") - F.col("slope")) ** 2).alias("linear"), F.avg((F.col("x") - F.col("level") - 0.5 * F.col("slope")) ** 2).alias("damped"), F.avg((F.col("x") - F.col("flat")) ** 2).alias("flat"))
    total = 1 / F.col("linear") + 1 / F.col("damped") + 1 / F.col("flat")
    return e.select(*[(1 / F.col(k) / total).alias(k) for k in ("linear", "damped", "flat")])


def category_courses(cells: DataFrame, *, strength: float = 50.0) -> DataFrame:
    """Each category's share of a period's events over its share of all, shrunk by ``strength`` events. cells: g, year, y."""
    per = cells.groupBy("g", "year").agg(F.sum("y").alias("y"))
    g, t, every = W.partitionBy("g"), W.partitionBy("year"), F.sum("y")
    total = per.agg(every.alias("_all"))
    mu = F.sum("y").over(g) * F.sum("y").over(t) / F.col("_all")
    return per.crossJoin(total).withColumn("mu", mu).select("g", "year", "y", "mu", F.log((F.col("y") + strength) / (F.col("mu") + strength)).alias("course"))  # total is one row


def mark_location(rows: DataFrame) -> DataFrame:
    """Log marks' means by place after category and year, shrunk by moments. rows: u, code, year, n, s (sum), ss (sum of squares)."""
    base = rows.groupBy("code").agg((F.sum("s") / F.sum("n")).alias("_m"))
    r = rows.join(base, "code").withColumn("_d", F.col("s") - F.col("n") * F.col("_m")).withColumn("_dd", F.col("ss") - 2 * F.col("_m") * F.col("s") + F.col("n") * F.col("_m") ** 2)
    per = r.groupBy("u").agg(F.sum("n").alias("n"), F.sum("_d").alias("_d"), F.sum("_dd").alias("_dd"))
    s = per.agg((F.sum(F.col("_dd") - F.col("_d") ** 2 / F.col("n")) / (F.sum("n") - F.count("*"))).alias("_v"), F.count("*").alias("_k"))
    per = per.crossJoin(s)  # one row
    tau = per.agg(F.greatest(F.lit(0.0), F.avg((F.col("_d") / F.col("n")) ** 2 - F.col("_v") / F.col("n"))).alias("_tau"))
    per = per.crossJoin(tau)  # one row
    return per.select("u", "n", (F.col("_d") / F.col("n") * F.col("_tau") / (F.col("_tau") + F.col("_v") / F.col("n"))).alias("location"))


def share_location(cells: DataFrame, *, strength: float = 20.0) -> DataFrame:
    """Log odds of a share in each place against all places', counts shrunk by ``strength``. cells: u, n, k."""
    per = cells.groupBy("u").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = per.agg((F.sum("k") / F.sum("n")).alias("_p"))
    p = (F.col("k") + strength * F.col("_p")) / (F.col("n") + strength)
    return per.crossJoin(total).select("u", "n", "k", (F.log(p / (1 - p)) - F.log(F.col("_p") / (1 - F.col("_p")))).alias("location"))  # one row


def supply_exponent(cells: DataFrame, exponents: list[float]) -> DataFrame:
    """(exponent, deviance) of expectations times a supply index to each power, levelled. cells: y, mu, index."""
    rows = cells.crossJoin(F.broadcast(cells.sparkSession.createDataFrame([(float(x),) for x in exponents], "exponent double")))  # the given few
    rows = rows.withColumn("m", F.col("mu") * F.pow("index", "exponent"))
    level = rows.groupBy("exponent").agg((F.sum("y") / F.sum("m")).alias("_l"))
    rows = rows.join(F.broadcast(level), "exponent").withColumn("m", F.col("m") * F.col("_l"))
    return rows.groupBy("exponent").agg((2 * F.sum(F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / F.col("m"))).otherwise(0.0) - (F.col("y") - F.col("m")))).alias("deviance"))
