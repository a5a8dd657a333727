"""Governed counts: every record is counted in a cell or reported with the first reason why it isn't."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.functions.cells import epi_week

CELL = ["u", "year", "sex", "age", "code"]


@dataclass
class EventCounts:
    """counts by cell, and unallocated by (year, reason, code); together they hold every record's weight."""

    counts: DataFrame
    unallocated: DataFrame


def reason(places: Column, *, dated: bool = False) -> Column:
    """The first reason why a record has no cell, null if it has one. ``places``: whether u is a known place."""
    r = F.when(~F.coalesce(places, F.lit(False)), "municipality").when(F.col("sex").isNull(), "sex")
    r = r.when(F.col("age").isNull() | (F.col("age") < 0), "age").when(F.col("code").isNull() | (F.col("code") == ""), "code")
    return r.when(F.col("date").isNull(), "date") if dated else r


def routed(cells: DataFrame, places: DataFrame, *, dated: bool = False) -> DataFrame:
    """``cells`` with ``reason``; ``places`` has the known places (u). The mark of a known place joins by equality."""
    known = places.select("u").distinct().withColumn("_known", F.lit(True))
    return cells.join(known, "u", "left").withColumn("reason", reason(F.col("_known"), dated=dated)).drop("_known")


def event_counts(cells: DataFrame, places: DataFrame, *, by: tuple[str, ...] = ()) -> EventCounts:
    """Weighted events by cell (and ``by``) and what was left out."""
    rows = routed(cells, places, dated="month" in by)
    counts = rows.where("reason is null").groupBy(*CELL, *by).agg(F.sum("wt").alias("y"))
    left = rows.where("reason is not null").groupBy("year", "reason", "code").agg(F.sum("wt").alias("y"))
    return EventCounts(counts, left)


def composition(cells: DataFrame, column: str, *, missing: tuple = ()) -> DataFrame:
    """Events by category value in place-years; blank and declared-missing values are counted apart, as null."""
    value = F.trim(F.col(column).cast("string"))
    value = F.when((value == "") | value.isin(*missing), None).otherwise(value) if missing else F.when(value != "", value)
    return cells.withColumn("value", value).groupBy("u", "year", "value").agg(F.sum("wt").alias("n"))


def shares(cells: DataFrame, column: str, success: tuple, *, missing: tuple = (), keys: tuple[str, ...] = ("u", "year"), quality: bool = False) -> DataFrame:
    """n recorded and k of them in ``success``; with ``quality`` n of all and k not recorded."""
    lost = F.col(column).isNull() | (F.col(column).isin(*missing) if missing else F.lit(False))
    if quality:
        return cells.groupBy(*keys).agg(F.sum("wt").alias("n"), F.sum(F.when(lost, F.col("wt")).otherwise(0)).alias("k"))
    hit = F.col(column).isin(*success)
    return cells.where(~lost).groupBy(*keys).agg(F.sum("wt").alias("n"), F.sum(F.when(hit, F.col("wt")).otherwise(0)).alias("k"))


def away(cells: DataFrame, place: str, *, divisor: int = 1, keys: tuple[str, ...] = ("u", "year")) -> DataFrame:
    """n with the other place recorded, k where it isn't the place of residence, at the level that ``divisor`` gives."""
    home = F.expr(f"u div {divisor}")
    rows = cells.where(F.col(place).isNotNull())
    return rows.groupBy(*keys).agg(F.sum("wt").alias("n"), F.sum(F.when(F.col(place) != home, F.col("wt")).otherwise(0)).alias("k"))


def marks(cells: DataFrame, *, low: float | None = None, high: float | None = None, not_recorded: tuple = ()) -> DataFrame:
    """``cells`` with ``mark_reason``: not recorded, missing or out of bounds, in that order; and ``log_mark``, null at 0 or less."""
    m = F.col("mark").try_cast("double")
    why = F.when(F.col("mark").isin(*not_recorded), "mark not recorded") if not_recorded else F.when(F.lit(False), "mark not recorded")
    why = why.when(m.isNull(), "mark missing").when((m < low if low is not None else F.lit(False)) | (m > high if high is not None else F.lit(False)), "mark out of bounds")
    return cells.withColumns({"mark_reason": why, "log_mark": F.when(m > 0, F.log(m))})


def mark_moments(rows: DataFrame, *, keys: tuple[str, ...] = ("u", "year", "code")) -> DataFrame:
    """n, sums and sums of squares of the mark and of its logarithm."""
    m, l = F.col("mark"), F.col("log_mark")
    return rows.where("mark_reason is null").groupBy(*keys).agg(F.count("*").alias("n"), F.sum(m).alias("s1"), F.sum(m * m).alias("s2"), F.sum(l).alias("l1"), F.sum(l * l).alias("l2"))


def casemix_adjusted(rows: DataFrame, stratum: str, group: str, *, prior: float = 10.0) -> DataFrame:
    """``rows`` with ``adjusted``: the log mark less the shrunk offset of its group within its stratum.

    offset = sum(log mark - stratum's mean) / (n + prior), for groups that aren't blank.
    """
    mean = rows.groupBy(stratum).agg(F.avg("log_mark").alias("_base"))
    based = rows.join(mean, stratum)
    offset = based.where(F.col(group) != "").groupBy(stratum, group).agg((F.sum(F.col("log_mark") - F.col("_base")) / (F.count("log_mark") + prior)).alias("_off"))
    return based.join(offset, [stratum, group], "left").withColumn("adjusted", F.col("log_mark") - F.coalesce("_off", F.lit(0.0))).drop("_base", "_off")


def mark_quantiles(rows: DataFrame, key: str, *, q: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """n and quantiles of the mark by ``key`` and over all; the total is told from a null key by ``total``."""
    qs = [F.percentile("mark", F.lit(p)).alias(f"q{round(100 * p)}") for p in q]
    return rows.where("mark_reason is null").rollup(key).agg(F.grouping(key).cast("int").alias("total"), F.count("*").alias("n"), *qs)


def exploded_codes(rows: DataFrame, codes: Column, *, keys: tuple[str, ...]) -> DataFrame:
    """Events once for each distinct category of their code list; those with none are left out."""
    return rows.withColumn("category", F.explode(codes)).groupBy(*keys, "category").agg(F.count("*").alias("y"))


def cooccurrence(rows: DataFrame, *, id: str, category: str, stratum: str, seed: str) -> DataFrame:
    """n_code, n_both, n, n_seed by stratum and category: events with it, with it and the seed, all, with the seed."""
    each = rows.select(id, stratum, category).distinct()
    per = each.groupBy(id, stratum).agg(F.max(F.when(F.col(category) == seed, 1).otherwise(0)).alias("has"))
    total = per.groupBy(stratum).agg(F.count("*").alias("n"), F.sum("has").alias("n_seed"))
    counted = each.join(per, [id, stratum]).where(F.col(category) != seed).groupBy(stratum, category).agg(F.count("*").alias("n_code"), F.sum("has").alias("n_both"))
    return counted.join(total, stratum)


def delays(cells: DataFrame, onset: str, report: str, *, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events by (u, epidemiological year, week, weeks of delay), and by year those left out: no dates, no place, negative."""
    y, w = epi_week(F.col(onset))
    rows = cells.withColumns({"epi_year": y, "week": w, "delay": F.expr(f"cast(datediff({report}, {onset}) as int) div 7")})
    good = F.col("u").isNotNull() & (F.datediff(report, onset) >= 0) & (F.col("delay") <= most if most is not None else F.lit(True))
    good = F.coalesce(good, F.lit(False))
    kept = rows.where(good).groupBy("u", "epi_year", "week", "delay").agg(F.count("*").alias("n"))
    return kept, rows.where(~good).groupBy("epi_year").agg(F.count("*").alias("left_out"))


def linked(records: DataFrame, pairs: DataFrame, *, id: str, keys: tuple[str, ...]) -> DataFrame:
    """n, k = sum of p and kv = sum of p(1 - p), where p is the record's best link (0 without any). pairs: l, p_match."""
    best = pairs.groupBy("l").agg(F.max("p_match").alias("p"))
    p = F.coalesce("p", F.lit(0.0))
    rows = records.join(best.withColumnRenamed("l", id), id, "left").withColumn("p", p)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("p").alias("k"), F.sum(F.col("p") * (1 - F.col("p"))).alias("kv"))


def link_completeness(stats: DataFrame) -> DataFrame:
    """Shares k/n of each key (n, k) shrunk to the whole by beta moments: (k + theta c) / (n + theta)."""
    total = stats.agg((F.sum("k") / F.sum("n")).alias("c"))
    rows = stats.crossJoin(total)  # one row
    share = F.col("k") / F.col("n")
    tau = rows.agg(
        F.greatest((F.sum(F.col("n") * (share - F.col("c")) ** 2) - F.sum(F.col("n") * F.col("c") * (1 - F.col("c")) / F.col("n"))) / F.sum("n"), F.lit(1e-6)).alias("tau2")
    )
    rows = rows.crossJoin(tau)  # one row
    theta = F.greatest(F.col("c") * (1 - F.col("c")) / F.col("tau2") - 1, F.lit(0.0))
    return rows.withColumn("theta", theta).withColumn("completeness", (F.col("k") + F.col("theta") * F.col("c")) / (F.col("n") + F.col("theta"))).drop("c", "tau2")


def facility_cube(cells: DataFrame) -> DataFrame:
    return cells.groupBy("u", "facility", "facility_place", "code", "year").agg(F.sum("wt").alias("y"))


def representative(rows: DataFrame, group: str, id: str) -> DataFrame:
    """The least id of each row's group; a row without group represents itself."""
    return rows.withColumn("rep", F.when(F.col(group).isNull(), F.col(id)).otherwise(F.min(id).over(W.partitionBy(group))))
