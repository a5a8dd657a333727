"""What may be counted where: cells that a code excludes, periods that are held back, and series of groups by national rates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Window as W, functions as F

_open: ContextVar[bool] = ContextVar("reserve_open", default=False)


class ReservedPeriod(ValueError):
    """Years that only the test of a claim may read."""


def restrictions(attributes: DataFrame, edges: list[int]) -> DataFrame:
    """(code, sex, low, high, never) of the codes that exclude some cell: the sex they allow (1, 2 or null for both), and bands.

    attributes: code, sex ("M", "F" or null), edit_sex and sex_edit, age_from, age_to and age_edit, underlying. A limit of an
    edit counts where the edit is "absolute"; others are improbable, not impossible. low, high: the first and last
    allowed band (bands begin at ``edges``, the last is open); a band is excluded only where it lies wholly outside the
    ages. never: codes that can't be an underlying cause.
    """
    only = F.coalesce("sex", F.when(F.col("sex_edit") == "absolute", F.col("edit_sex")))
    rows = attributes.withColumns({"_sex": F.when(only == "M", 1).when(only == "F", 2), "_age": F.coalesce(F.col("age_edit") == "absolute", F.lit(False)), "never": ~F.coalesce("underlying", F.lit(True))})
    lows, highs = [float(e) for e in edges], [*[float(e) for e in edges[1:]], float("inf")]
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(zip(lows, highs))])
    begin, end = F.coalesce("age_from", F.lit(0)).cast("double"), F.coalesce(F.col("age_to").cast("double"), F.lit(float("inf")))
    inside = F.filter(bands, lambda x: (x["b"] > begin) & (x["a"] < end))
    rows = rows.withColumns({"_in": F.when(F.col("_age"), F.transform(inside, lambda x: x["i"]))})
    rows = rows.withColumns({"low": F.when(F.col("_age"), F.coalesce(F.array_min("_in"), F.lit(len(edges)))), "high": F.when(F.col("_age"), F.coalesce(F.array_max("_in"), F.lit(-1)))})
    narrow = F.col("never") | F.col("_sex").isNotNull() | (F.col("low") > 0) | (F.col("high") < len(edges) - 1)
    return rows.where(narrow).select("code", F.col("_sex").alias("sex"), "low", "high", "never")


def possible(records: DataFrame, rules: DataFrame, edges: list[int]) -> DataFrame:
    """``records`` (code, sex, age, reason) whose reason is "cause" or "impossible" where the code rules the record's cell out.

    Reasons that a record has already stay; so records that are counted and reasons together hold them all.
    """
    band = sum((F.when(F.col("age") >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0))
    r = rules.select("code", F.col("sex").alias("_sex"), "low", "high", "never")
    rows = records.join(F.broadcast(r), "code", "left")  # a row for each restricted code of the classification
    out = (F.col("_sex") != F.col("sex")) | (band < F.col("low")) | (band > F.col("high"))
    why = F.when(F.col("never"), "cause").when(F.coalesce(out, F.lit(False)), "impossible")
    return rows.withColumn("reason", F.coalesce("reason", why)).select(*records.columns)


@contextmanager
def reserve_open() -> Iterator[None]:
    """Inside this block reserved periods may be read: for the test of a claim."""
    token = _open.set(True)
    try:
        yield
    finally:
        _open.reset(token)


def check_reserved(dataset: str, years: Iterable[int], reserved: dict[str, set[int]]) -> None:
    """Raises ``ReservedPeriod`` where years of a dataset belong to its reserve and no claim is being tested."""
    hit = sorted({int(y) for y in years} & reserved.get(dataset, set()))
    if hit and not _open.get():
        raise ReservedPeriod(f"{dataset}: {hit} are held back for the tests of claims")


def unreserved(cells: DataFrame, dataset: str, reserved: dict[str, set[int]]) -> DataFrame:
    """``cells`` once their years are known to be free; a reserved one raises, it isn't left out silently."""
    check_reserved(dataset, [r[0] for r in cells.select("year").distinct().collect()], reserved)  # the calendar's years
    return cells


def group_series(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, year, observed, expected) of groups of places, expected at each year's rates of all places by stratum.

    cells: u, year, stratum, y, n. groups: u, grp; a place may be in several or in none (it counts for the rates all the same).
    """
    at = W.partitionBy("year", "stratum")
    total = F.sum("n").over(at)
    rows = cells.withColumn("_e", F.when(total > 0, F.col("n") * F.sum("y").over(at) / total).otherwise(0.0))
    return rows.join(groups, "u").groupBy("grp", "year").agg(F.sum("y").alias("observed"), F.sum("_e").alias("expected"))
