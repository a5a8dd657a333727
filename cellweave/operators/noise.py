"""Noise of cells around their expectation, facility effects, and planted signals for measuring power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.operators.error_control import halves
from cellweave.operators.expectation import scattered


def winsorised_scores(cells: DataFrame, *, bound: float = 3.5) -> DataFrame:
    """(u, year, e): scaled residuals less each place's level and slope, cut at ``bound``. cells: u, year, y, mu, phi."""
    r = (F.col("y") - F.col("mu")) / F.sqrt(F.col("mu") + F.col("mu") ** 2 / F.col("phi"))
    w = W.partitionBy("u")
    rows = cells.withColumns({"_r": r, "_t": F.col("year").cast("double")})
    rows = rows.withColumns({"_rm": F.avg("_r").over(w), "_tm": F.avg("_t").over(w)})
    slope = F.sum((F.col("_t") - F.col("_tm")) * (F.col("_r") - F.col("_rm"))).over(w) / F.sum((F.col("_t") - F.col("_tm")) ** 2).over(w)
    e = F.col("_r") - F.col("_rm") - slope * (F.col("_t") - F.col("_tm"))
    return rows.select("u", "year", F.greatest(F.lit(-bound), F.least(F.lit(bound), e)).alias("e"))


def autocorrelation(scores: DataFrame, lags: int) -> DataFrame:
    """Correlation at lags 1 to ``lags`` of scores over all places: sums of products over the sum of squares."""
    w = W.partitionBy("u").orderBy("year")
    rows = scores.withColumns({f"l{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)})
    total = F.sum(F.col("e") ** 2)
    one = rows.agg(*[(F.sum(F.col("e") * F.col(f"l{k}")) / total).alias(f"l{k}") for k in range(1, lags + 1)])
    return one.select(F.explode(F.create_map(*[x for k in range(1, lags + 1) for x in (F.lit(k), F.col(f"l{k}"))])).alias("lag", "rho"))


def trend_inflation(rho: Column) -> Column:
    """By how much autocorrelation inflates the variance of a mean: (1 + rho) / (1 - rho)."""
    return (1 + rho) / (1 - rho)


def kappa(surprises: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Spread of the middle half of z over that of a normal, squared, among cells expected at least ``least``; 1 below 50 cells."""
    rows = surprises.where(F.col("mu") >= least)
    q = lambda p: F.percentile("z", F.lit(p))
    return rows.agg(F.when(F.count("*") >= 50, ((q(0.75) - q(0.25)) / 1.349) ** 2).otherwise(F.lit(1.0)).alias("kappa"))


def facility_effects(rows: DataFrame) -> DataFrame:
    """Shrunk effects of facilities on a residual: mean times tau2 / (tau2 + s2 / n), tau2 by DerSimonian and Laird.

    rows: facility, n, sr, sr2 (sums of residuals and of their squares).
    """
    f = rows.groupBy("facility").agg(F.sum("n").alias("n"), F.sum("sr").alias("sr"), F.sum("sr2").alias("sr2"))
    pooled = f.agg((F.sum(F.col("sr2") - F.col("sr") ** 2 / F.col("n")) / F.sum(F.col("n") - 1)).alias("s2"), (F.sum("sr") / F.sum("n")).alias("m"), F.sum("n").alias("total"), F.sum(F.col("n").cast("double") ** 2).alias("squares"), F.count("*").alias("k"))
    f = f.crossJoin(pooled)  # one row
    q = f.agg((F.sum(F.col("n") * (F.col("sr") / F.col("n") - F.col("m")) ** 2) / F.first("s2")).alias("q"))
    f = f.crossJoin(q)  # one row
    c = (F.col("total") - F.col("squares") / F.col("total")) / F.col("s2")
    f = f.withColumn("tau2", F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / c))
    return f.select("facility", "n", ((F.col("sr") / F.col("n") - F.col("m")) * F.col("tau2") / (F.col("tau2") + F.col("s2") / F.col("n"))).alias("effect"))


def event_sides(cells: DataFrame, share: float, *, keys: tuple[str, str]) -> DataFrame:
    """Counts split in two sides at random, each event by itself: the sides are thinned counts that add up to y.

    Events of a cell are numbered by ``sequence``, so the work follows the events; cell (two whole numbers) and number decide.
    """
    each = cells.where("y > 0").select(*keys, F.explode(F.sequence(F.lit(1), F.col("y").cast("int"))).alias("_i"))
    first = each.groupBy(*keys).agg(F.sum((scattered(*keys, "_i") < share).cast("int")).alias("a"))
    rows = cells.join(first, list(keys), "left").withColumn("a", F.coalesce("a", F.lit(0)))
    return rows.withColumn("b", F.col("y") - F.col("a"))


def planted(cells: DataFrame, where: Column, theta: float, *, shape: str = "spike", first: int | None = None) -> DataFrame:
    """``cells`` whose counts are raised by a factor in some of them: a spike, or a step or ramp from ``first`` on."""
    over = {"spike": F.lit(theta), "step": F.when(F.col("year") >= first, theta).otherwise(1.0), "ramp": F.when(F.col("year") >= first, 1 + (theta - 1) * (F.col("year") - first + 1) / 3).otherwise(1.0)}[shape]
    return cells.withColumn("y", F.when(where, F.round(F.col("y") * over)).otherwise(F.col("y")).cast("long"))


def jurisdictions(cells: DataFrame, *, place: str, state: str, own: Column) -> DataFrame:
    """Whether other states show what a locus's own states do: observed, expected and ratio inside and outside, by side.

    The other states are halved at random, so that the two halves share no jurisdiction.
    """
    rows = halves(cells.withColumns({"_own": own, "_every": F.lit(0)}), unit=state, within="_every")
    side = F.when(F.col("_own"), "own").otherwise(F.concat(F.lit("half "), F.col("half").cast("string")))
    per = rows.groupBy(side.alias("side")).agg(F.count_distinct(place).alias("places"), F.sum("y").alias("y"), F.sum("mu").alias("mu"))
    return per.withColumn("ratio", (F.col("y") + 0.5) / (F.col("mu") + 0.5))


def explained_away(cells: DataFrame, driver: str) -> DataFrame:
    """Share of a departure's deviance that a covariate absorbs: 1 - D' / D, mu scaled by exp(b (x - mean)), b by least squares.

    cells: y, mu and the driver.
    """
    r = F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5))
    x, w = F.col(driver).cast("double"), F.col("mu")
    s = cells.agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * r).alias("wr"), F.sum(w * x * r).alias("wxr"), F.sum(w * x * x).alias("wxx"))
    s = s.select((F.col("wx") / F.col("w")).alias("_m"), ((F.col("wxr") - F.col("wx") * F.col("wr") / F.col("w")) / (F.col("wxx") - F.col("wx") ** 2 / F.col("w"))).alias("_b"), (F.col("wr") / F.col("w")).alias("_a"))
    rows = cells.crossJoin(s).withColumn("_mu", w * F.exp(F.col("_a") + F.col("_b") * (x - F.col("_m"))))  # s is one row
    dev = lambda m: 2 * F.sum(F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / m)).otherwise(0.0) - (F.col("y") - m))
    return rows.agg((1 - dev(F.col("_mu")) / dev(w)).alias("absorbed"), F.first("_b").alias("slope"))


def lag_covariance(cells: DataFrame, lag: int) -> DataFrame:
    """(u, year, covariance) of each cell and the one ``lag`` years before: the scaled residuals' common correlation times both deviations."""
    sd = F.sqrt(F.col("mu") + F.col("mu") ** 2 / F.col("phi"))
    w = W.partitionBy("u").orderBy("year")
    rows = cells.select("u", "year", ((F.col("y") - F.col("mu")) / sd).alias("_r"), sd.alias("_sd")).withColumns({"_r1": F.lag("_r", lag).over(w), "_sd1": F.lag("_sd", lag).over(w)})
    rho = rows.agg((F.sum(F.col("_r") * F.col("_r1")) / F.sum(F.col("_r") ** 2)).alias("_rho"))
    return rows.where("_sd1 is not null").crossJoin(rho).select("u", "year", (F.col("_rho") * F.col("_sd") * F.col("_sd1")).alias("covariance"))  # one row
