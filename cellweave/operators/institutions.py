"""Is a place's change that of the institutions that record it? All places at once, from counts by place, facility and year."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from cellweave.functions import distributions as d

#: Fixed values of the rule: least events of a change; most facilities, and their part of the change; the part of the place's
#: block from which on they are the place; p of their part against their size; ratio of volumes; events of other residents
#: that say something; z of their step.
LEAST_EXCESS, MOST, PART, SOLE, LEVEL, VOLUME, LEAST_OTHERS, STEP = 10.0, 3, 0.7, 0.85, 1e-3, 1.6, 30, 3.0


def evidence(cells: DataFrame, window: Column, *, direction: int = 1) -> DataFrame:
    """For each place how its change from the other years to ``window`` lies with its facilities.

    cells: u, facility (null: none named), year, lead, block (with the lead), total (with the block): counts of residents.
    excess: the change per year in ``direction``, over the facilities that moved that way, times the window's years.
    k: the least number of facilities, three at most, that carry 0.7 of it (null if more would be needed), by
    falling part, ties by facility; of these (of the first, where k is null): facilities; share: their part of it; ref_share: of
    the block in the other years; volume_base, volume: their yearly events without the lead's; inside: the log ratio of the
    lead's share of the block; others: the lead's events among these facilities' residents of other places, outside and
    outside_z: that log ratio among them and its z (null where there are too few).
    """
    y = cells.select("year").distinct().agg(F.count_if(window).alias("_nw"), F.count_if(~window).alias("_nb"))
    kinds = ("lead", "block", "total")
    sums = [F.sum(F.when(window if side == "w" else ~window, F.col(c)).otherwise(0)).alias(f"{c}_{side}") for c in kinds for side in "wb"]
    per = cells.groupBy("u", "facility").agg(*sums).crossJoin(y)  # y is one row
    moved = F.lit(direction) * (F.col("lead_w") / F.col("_nw") - F.col("lead_b") / F.col("_nb"))
    per = per.withColumn("_d", F.greatest(moved, F.lit(0.0))).withColumn("_pos", F.when(F.col("facility").isNotNull(), F.col("_d")).otherwise(0.0))
    own = W.partitionBy("u")
    down = own.orderBy(F.desc("_pos"), F.asc_nulls_last("facility"))
    per = per.withColumns({"_gain": F.sum("_d").over(own), "_ref": F.sum("block_b").over(own), "_rank": F.row_number().over(down), "_upto": F.sum("_pos").over(down.rowsBetween(W.unboundedPreceding, 0)), "_real": F.count("facility").over(own)})
    enough = (F.col("_rank") <= MOST) & (F.col("_gain") > 0) & (F.col("_upto") >= PART * F.col("_gain"))
    per = per.withColumn("k", F.min(F.when(enough, F.col("_rank"))).over(own))
    top = per.where((F.col("_rank") <= F.coalesce("k", F.lit(1))) & F.col("facility").isNotNull())
    whole = cells.where(F.col("facility").isNotNull()).groupBy("facility").agg(*[s for s, c in zip(sums, [c for c in kinds for _ in "wb"]) if c != "total"])
    whole = whole.select("facility", *[F.col(f"{c}_{s}").alias(f"_all_{c}_{s}") for c in ("lead", "block") for s in "wb"])
    top = top.join(whole, "facility")
    outside = {f"o_{c}_{s}": F.sum(F.col(f"_all_{c}_{s}") - F.col(f"{c}_{s}")) for c in ("lead", "block") for s in "wb"}
    found = top.groupBy("u").agg(
        F.first("k").alias("k"),
        F.sort_array(F.collect_list("facility")).alias("facilities"),
        (F.first("_gain") * F.first("_nw")).alias("excess"),
        F.when(F.first("_gain") > 0, F.sum("_pos") / F.first("_gain")).alias("share"),
        F.when(F.first("_ref") > 0, F.sum("block_b") / F.first("_ref")).otherwise(0.0).alias("ref_share"),
        (F.sum(F.col("total_b") - F.col("lead_b")) / F.first("_nb")).alias("volume_base"),
        (F.sum(F.col("total_w") - F.col("lead_w")) / F.first("_nw")).alias("volume"),
        F.log((F.sum("lead_w") + 0.5) / (F.sum("block_w") + 1) * (F.sum("block_b") + 1) / (F.sum("lead_b") + 0.5)).alias("inside"),
        *[e.alias(n) for n, e in outside.items()],
    )
    others = F.col("o_lead_w") + F.col("o_lead_b")
    says = (others >= LEAST_OTHERS) & (F.col("o_block_w") > 0) & (F.col("o_block_b") > 0)
    ratio = F.log((F.col("o_lead_w") + 0.5) / (F.col("o_block_w") + 1) * (F.col("o_block_b") + 1) / (F.col("o_lead_b") + 0.5))
    found = found.withColumns({"others": others, "outside": F.when(says, ratio), "outside_z": F.when(says, ratio / F.sqrt(1 / (F.col("o_lead_w") + 0.5) + 1 / (F.col("o_lead_b") + 0.5)))})
    return found.drop(*outside)


@pandas_udf(T.DoubleType())
def _at_least(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) of a binomial; null where any of the three is."""
    a, m, q = (s.to_numpy(float) for s in (k, n, p))
    unknown = np.isnan(a) | np.isnan(m) | np.isnan(q)
    a, m, q = (np.where(unknown, 1.0, v) for v in (a, m, q))
    inner = d.beta_cdf(np.clip(q, 1e-9, 1 - 1e-9), np.maximum(a, 1), np.maximum(m - a + 1, 1))
    out = np.where(a <= 0, 1.0, np.where(a > m, 0.0, inner))
    return pd.Series([None if u else float(x) for u, x in zip(unknown, out)], dtype="Float64")


def mechanism(cells: DataFrame, window: Column, *, direction: int = 1) -> DataFrame:
    """``evidence`` with p (that facilities of this size carry such a part by chance, null where they are the place) and reading.

    reading: "small" (fewer than ten events), "spread" (over more than three facilities), "size" (no more than their size
    would carry), "catchment" (their residents of other places show the same step: at least half of it, with z of 3),
    "volume" (their other events rose or fell by 1.6 times: opened, closed, entered or left the data), "place" (the
    others they serve don't move), "open" (too few others to tell). Catchment and volume are readings of an institution.
    """
    rows = evidence(cells, window, direction=direction)
    n = F.bround("excess", 0)
    p = _at_least(F.bround(F.col("share") * n, 0), n, "ref_share")
    rows = rows.withColumn("p", F.when((F.col("ref_share") < SOLE) & (F.col("excess") > 0), p))
    change = (F.col("volume") + 1) / (F.col("volume_base") + 1)
    same = (direction * F.col("outside_z") >= STEP) & (direction * F.col("outside") >= 0.5 * direction * F.col("inside"))
    reading = F.when((F.col("excess") < LEAST_EXCESS) | F.col("excess").isNull(), "small").when(F.col("k").isNull(), "spread").when(F.col("p") >= LEVEL, "size")
    reading = reading.when(same, "catchment").when((change >= VOLUME) | (change <= 1 / VOLUME), "volume").when(F.col("outside").isNotNull(), "place").otherwise("open")
    return rows.withColumns({"sole": F.col("ref_share") >= SOLE, "reading": reading})
