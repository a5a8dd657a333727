"""Expectations: standardisation, proportional fitting, shrinkage, tiers, and how surprising cells are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cellweave.functions.tails import randomised_pit
from cellweave.sources.scratch import staged


def crude_and_standardised(cells: DataFrame, exposure: DataFrame, *, unit: str = "u", per: float = 100_000.0) -> DataFrame:
    """Crude and directly standardised rates of each unit; the standard is all units' exposure by group.

    cells: unit, g, y. exposure: unit, g, n.
    """
    standard = exposure.groupBy("g").agg(F.sum("n").alias("std"))
    rows = exposure.groupBy(unit, "g").agg(F.sum("n").alias("n")).join(cells.groupBy(unit, "g").agg(F.sum("y").alias("y")), [unit, "g"], "left").join(standard, "g")
    y = F.coalesce("y", F.lit(0))
    return rows.groupBy(unit).agg(F.sum(y).alias("y"), F.sum("n").alias("n"), (F.sum(y) / F.sum("n") * per).alias("crude"), (F.sum(F.col("std") * y / F.col("n")) / F.sum("std") * per).alias("standardised"))


def indirect(cells: DataFrame, exposure: DataFrame, *, unit: str = "u") -> DataFrame:
    """Observed, expected at the whole's rates by group, and (O + 1/2) / (E + 1/2)."""
    n = exposure.groupBy(unit, "g").agg(F.sum("n").alias("n"))
    y = cells.groupBy(unit, "g").agg(F.sum("y").alias("y"))
    both = n.join(y, [unit, "g"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    rate = both.groupBy("g").agg((F.sum("y") / F.sum("n")).alias("rate"))
    out = both.join(rate, "g").groupBy(unit).agg(F.sum("y").alias("observed"), F.sum(F.col("n") * F.col("rate")).alias("expected"))
    return out.withColumn("ratio", (F.col("observed") + 0.5) / (F.col("expected") + 0.5))


def proportional_fit(cells: DataFrame, margins: list[list[str]], *, value: str = "y", exposure: str = "n", sweeps: int = 20, checkpoint_every: int = 10) -> DataFrame:
    """``cells`` with ``mu``: exposure times factors that make every margin of mu equal that of the values.

    Each sweep is one window sum per margin over the cell table; lineage is cut every few sweeps.
    """
    out = cells.withColumn("mu", F.col(exposure).cast("double"))
    for i in range(sweeps):
        for keys in margins:
            w = W.partitionBy(*keys)
            seen, fitted = F.sum(value).over(w), F.sum("mu").over(w)
            out = out.withColumn("mu", F.when(fitted > 0, F.col("mu") * seen / fitted).otherwise(0.0))
        if (i + 1) % checkpoint_every == 0:
            out = staged(out, "fit")
    return out


def shrunk_places(cells: DataFrame, *, unit: str = "u") -> DataFrame:
    """Gamma-Poisson shrinkage of each unit's ratio: (O + a) / (E + a), a by moments of the ratios' spread.

    cells: unit, observed, expected.
    """
    r = F.col("observed") / F.col("expected")
    m = cells.agg((F.sum("observed") / F.sum("expected")).alias("m"), F.sum("expected").alias("e"), F.count("*").alias("k"))
    rows = cells.crossJoin(m)  # one row
    v = rows.agg((F.sum(F.col("expected") * (r - F.col("m")) ** 2) / F.first("e") - F.first("m") * F.first("k") / F.first("e")).alias("v"))
    rows = rows.crossJoin(v)  # one row
    a = F.col("m") * F.col("m") / F.greatest(F.col("v"), F.lit(1e-9))
    rows = rows.withColumn("a", a).withColumn("shrunk", (F.col("observed") + F.col("a")) / (F.col("expected") + F.col("a") / F.col("m")))
    return rows.select(unit, "observed", "expected", "shrunk")


def releveled(cells: DataFrame, *, period: str = "year") -> DataFrame:
    """B0: the expectation without place terms (mu0) rescaled to each period's total of the one with them (mu1)."""
    w = W.partitionBy(period)
    return cells.withColumn("mu", F.col("mu0") * F.sum("mu1").over(w) / F.sum("mu0").over(w))


def lifted(cells: DataFrame, units: DataFrame, *, period: str = "year") -> DataFrame:
    """Counts at a coarser support: sums, and phi' = M**2 / sum(mu**2 / phi)."""
    rows = cells.join(units, "u").groupBy("unit", period)
    return rows.agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"), (F.sum("mu") ** 2 / F.sum(F.col("mu") ** 2 / F.col("phi"))).alias("phi"))


def dispersion(cells: DataFrame) -> DataFrame:
    """phi by moments over cells: sum(mu**2) / sum((y - mu)**2 - mu), at least 0.01; without excess spread 1e9."""
    over = F.sum((F.col("y") - F.col("mu")) ** 2 - F.col("mu"))
    return cells.agg(F.when(over > 0, F.greatest(F.sum(F.col("mu") ** 2) / over, F.lit(0.01))).otherwise(F.lit(1e9)).alias("phi"))


def uniform(*keys: str, seed: str = ""):
    """A uniform number in (0, 1) that depends on the keys alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def scattered(*keys: str):
    """A uniform number in [0, 1) that depends on whole-number keys alone, by arithmetic that any engine has."""
    total = F.lit(0).cast("long")
    for k, prime in zip(keys, (73_856_093, 19_349_663, 83_492_791)):
        total = total + F.col(k).cast("long") * F.lit(prime)
    mixed = F.pmod(F.pmod(total, F.lit(1 << 31)) * F.lit(2_654_435_761), F.lit(1 << 32))
    mixed = F.pmod(F.shiftright(mixed, 9) * F.lit(1_103_515_245) + F.lit(12_345), F.lit(1 << 31))
    return mixed / F.lit(float(1 << 31))


def surprise(cells: DataFrame, *, keys: tuple[str, ...] = ("u", "year")) -> DataFrame:
    """Randomised PIT, z and weight w = mu / (1 + mu / phi) of each cell (y, mu, phi)."""
    rows = cells.withColumn("_p", randomised_pit("y", "mu", "phi", uniform(*keys, seed="pit")))
    return rows.withColumns({"pit": F.col("_p.u"), "z": F.col("_p.z"), "w": F.col("mu") / (1 + F.col("mu") / F.col("phi"))}).drop("_p")


def calibration(surprises: DataFrame, *, by: str | None = None, bins: int = 1000) -> DataFrame:
    """Kolmogorov-Smirnov distance of the PITs from uniform, overall or by group, from counts in ``bins`` bins.

    The distance is exact to 1 / bins. Counting first keeps the ordered window to ``bins`` rows a group.
    """
    keys = [by] if by else []
    count = surprises.withColumn("bin", F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1))).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    every = W.partitionBy(*keys) if by else W.partitionBy(F.lit(0))
    upto = every.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    rows = count.withColumns({"have": F.sum("n").over(upto), "all": F.sum("n").over(every)})
    far = F.greatest(F.abs(F.col("have") / F.col("all") - (F.col("bin") + 1) / bins), F.abs((F.col("have") - F.col("n")) / F.col("all") - F.col("bin") / bins))
    return rows.groupBy(*keys).agg(F.max(far).alias("ks"), F.first("all").alias("cells"))


def forecasts(series: DataFrame, *, horizon: int, damping: float = 0.5) -> DataFrame:
    """Each unit's next log-level by linear, damped and flat rules. series: u, t (0, 1, ...), x."""
    last = W.partitionBy("u").orderBy(F.desc("t"))
    w = W.partitionBy("u")
    fit = series.withColumns({"nth": F.row_number().over(last), "tm": F.avg("t").over(w), "xm": F.avg("x").over(w)})
    per = fit.groupBy("u").agg(
        F.max(F.when(F.col("nth") == 1, F.col("x"))).alias("level"),
        (F.sum((F.col("t") - F.col("tm")) * (F.col("x") - F.col("xm"))) / F.sum((F.col("t") - F.col("tm")) ** 2)).alias("slope"),
        F.avg("x").alias("flat"),
        F.median("x").alias("median"),
    )
    step = damping * (1 - damping**horizon) / (1 - damping)
    return per.select("u", (F.col("level") + horizon * F.col("slope")).alias("linear"), (F.col("level") + step * F.col("slope")).alias("damped"), "flat", "median")


def imputed(cells: DataFrame, flag) -> DataFrame:
    """Flagged cells' counts replaced by their expectation, for a refit."""
    return cells.withColumn("flagged", flag).withColumn("y", F.when(F.col("flagged"), F.col("mu")).otherwise(F.col("y")))
