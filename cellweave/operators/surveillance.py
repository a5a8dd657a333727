"""Prospective surveillance: reporting delays, nowcasts of eventual counts, thresholds and alarms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cellweave.functions import distributions as d
from cellweave.functions.tails import nb_threshold


def delay_shares(table: DataFrame, *, most: int, least: int = 20) -> DataFrame:
    """(u, delay, share, cumulative): each place's delays shrunk to the whole's: (C + a nat) / (tot + a).

    a comes from Dirichlet moments over places with at least ``least`` events. table: u, delay, n.
    """
    t = table.where(F.col("delay").between(0, most)).groupBy("u", "delay").agg(F.sum("n").alias("c"))
    nat = t.groupBy("delay").agg(F.sum("c").alias("c")).withColumn("nat", F.col("c") / F.sum("c").over(W.partitionBy(F.lit(0)))).select("delay", "nat")
    tot = t.groupBy("u").agg(F.sum("c").alias("tot"))
    grid = tot.withColumn("delay", F.explode(F.sequence(F.lit(0), F.lit(most)))).join(t, ["u", "delay"], "left").join(nat, "delay", "left")
    grid = grid.select("u", "delay", "tot", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("nat", F.lit(0.0)).alias("nat"))
    big = grid.where(F.col("tot") >= least)
    spread = big.agg(F.sum((F.col("c") / F.col("tot") - F.col("nat")) ** 2).alias("v"), F.sum(F.col("nat") * (1 - F.col("nat"))).alias("s"), F.sum(F.col("nat") * (1 - F.col("nat")) / F.col("tot")).alias("e"))
    a = spread.select(F.when(F.col("v") > F.col("e"), F.least(F.lit(1e6), (F.col("s") - F.col("v")) / (F.col("v") - F.col("e")))).otherwise(F.lit(1e6)).alias("a"))
    out = grid.crossJoin(a)  # one row
    out = out.withColumn("share", (F.col("c") + F.greatest("a", F.lit(0.0)) * F.col("nat")) / (F.col("tot") + F.greatest("a", F.lit(0.0))))
    upto = W.partitionBy("u").orderBy("delay").rowsBetween(W.unboundedPreceding, 0)
    return out.select("u", "delay", "share", F.sum("share").over(upto).alias("cumulative"))


def nowcast(cells: DataFrame) -> DataFrame:
    """Expected eventual count of cells (y known so far, f share reported by now, mu, phi): y + (phi + y)(1 - f) / r, r = phi / mu + f."""
    r = F.col("phi") / F.col("mu") + F.col("f")
    return cells.withColumn("eventual", F.col("y") + (F.col("phi") + F.col("y")) * (1 - F.col("f")) / r)


def alarms(cells: DataFrame, *, recurrence: float = 260.0, confidence: float = 0.5) -> DataFrame:
    """``cells`` with threshold (the least count of tail at most 1 / recurrence), probability of reaching it, and alarm."""
    rows = nowcast(cells).withColumn("threshold", nb_threshold(F.col("mu").cast("double"), F.col("phi").cast("double"), F.lit(1 / recurrence)))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            y, f, mu, phi = (x[c].to_numpy(float) for c in ("y", "f", "mu", "phi"))
            r = phi / mu + f
            mean = (phi + y) * (1 - f) / r
            p = d.nb_sf(x["threshold"].to_numpy(float) - 1 - y, mean, phi + y)
            yield x.assign(probability=p)

    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)
    return rows.mapInPandas(reach, schema + ", probability double").withColumn("alarm", F.col("probability") >= confidence)


def expected_false_alarms(places: int, weeks: int, recurrence: float = 260.0) -> float:
    return places * weeks / recurrence
