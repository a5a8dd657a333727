"""Exposures: denominators by place, period and group, and what modifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def lattice(places: DataFrame, periods: DataFrame) -> DataFrame:
    """Every place in every period. Both are tables of names, with a row for each place or period, never of events."""
    return places.distinct().crossJoin(periods.distinct())


def events_population(counts: DataFrame, places: DataFrame, years: DataFrame, *, lag: int = 0) -> DataFrame:
    """Another event type's counts (u, year, y) as denominator, 0 where there are none, ``lag`` years earlier."""
    shifted = counts.groupBy("u", (F.col("year") + lag).alias("year")).agg(F.sum("y").alias("_n"))
    return lattice(places, years).join(shifted, ["u", "year"], "left").select("u", "year", F.coalesce("_n", F.lit(0)).cast("double").alias("n"))


def banded(single: DataFrame, band: Column, *, keys: tuple[str, ...] = ("u", "year", "sex")) -> DataFrame:
    """Single ages (n, sd) summed into bands; s = sum(sd) / sum(n), as for perfectly correlated ages."""
    return single.withColumn("band", band).groupBy(*keys, "band").agg(F.sum("n").alias("n"), (F.sum("sd") / F.sum("n")).alias("s"))


def split_pooled(rows: DataFrame, column: str, *, sign: str = "+") -> DataFrame:
    """Pooled places ("a+b") as a row for each member, with a share of ``n`` each."""
    parts = F.split(F.col(column), f"[{sign}]")
    return rows.withColumn("_m", F.size(parts)).withColumn(column, F.explode(parts)).withColumn("n", F.col("n") / F.col("_m")).drop("_m")


def modified(population: DataFrame, kappa: DataFrame, *, on: list[str], factor: str, sd: str | None = None) -> DataFrame:
    """n times a factor known by ``on``, the sds of logarithms added in squares; cells without the factor are dropped."""
    out = population.join(kappa, on).withColumn("n", F.col("n") * F.col(factor))
    if sd:
        out = out.withColumn("s", F.sqrt(F.col("s") ** 2 + F.col(sd) ** 2)).drop(sd)
    return out.drop(factor)


def recorded(population: DataFrame, confusion: DataFrame) -> DataFrame:
    """Exposure of recorded groups: sum over true groups j of C(k given j) r_j N_j; groups without a row keep their own.

    population: u, year, sex, g, n. confusion: k, j, sex (-1 for any), c, r. The two kinds of rows join by equality each.
    """
    p = population.withColumnRenamed("g", "j")
    own = confusion.where("sex <> -1").join(p, ["j", "sex"])
    both = confusion.where("sex = -1").drop("sex").join(p, "j")
    cols = ["u", "year", "sex", F.col("k").alias("g"), (F.col("c") * F.col("r") * F.col("n")).alias("n")]
    mixed = own.select(*cols).unionByName(both.select(*cols)).groupBy("u", "year", "sex", "g").agg(F.sum("n").alias("n"))
    untouched = population.join(confusion.select(F.col("k").alias("g")).distinct(), "g", "left_anti")
    return mixed.unionByName(untouched.select("u", "year", "sex", "g", "n"))


def lifted_sum(values: DataFrame, units: DataFrame, *, by: tuple[str, ...] = ("year",)) -> DataFrame:
    """Sums at a coarser support; units: u, unit. Places without a unit raise no silent loss: they come as a null unit."""
    return values.join(units, "u", "left").groupBy("unit", *by).agg(F.sum("y").alias("y"))


def lifted_ratio(values: DataFrame, units: DataFrame, *, by: tuple[str, ...] = ("year",)) -> DataFrame:
    """Ratio of sums at a coarser support (y over n)."""
    return values.join(units, "u", "left").groupBy("unit", *by).agg((F.sum("y") / F.sum("n")).alias("value"))


def lifted_mean(values: DataFrame, units: DataFrame, *, by: tuple[str, ...] = ("year",)) -> DataFrame:
    """Precision-weighted mean (value, w) and its variance at a coarser support."""
    return values.join(units, "u", "left").groupBy("unit", *by).agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"), (1 / F.sum("w")).alias("variance"))


def lift(law: str):
    """The lifting operator of a law; levels refuse to be lifted."""
    laws = {"sum": lifted_sum, "ratio_of_sums": lifted_ratio, "weighted_mean": lifted_mean}
    if law not in laws:
        raise ValueError(f"a field of law {law!r} has no meaning at a coarser support")
    return laws[law]
