"""Propagation: first departures of places, and whether they come later the farther places lie from a source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.operators.ranking import running
from cellweave.sources.scratch import staged

#: Fixed values of the method: surrogates of a search, waves at most, places of a disc at least, spread of a wave's members.
SURROGATES, MAX_WAVES, LEAST, SPREAD, LEAST_SD = 999, 5, 10, 2.0, 0.5
#: No correlation counts as closer to 1 than this.
NEARLY_ONE = 0.999999


def onsets(hits: DataFrame) -> DataFrame:
    """(u, onset): each place's first departing period. hits: u, year, rejected."""
    return hits.where("rejected").groupBy("u").agg(F.min("year").alias("onset"))


def absent_before(cells: DataFrame, onset: DataFrame) -> DataFrame:
    """Places without any event before their onset, whose expectation then made none likely: exp(-sum of mu) at least 1/2."""
    before = cells.join(onset, "u").where("year < onset").groupBy("u").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"))
    rows = onset.join(before, "u", "left")
    return rows.withColumn("absent", (F.coalesce("y", F.lit(0)) == 0) & (F.exp(-F.coalesce("mu", F.lit(0.0))) >= 0.5)).select("u", "onset", "absent")


def _levels(onset: DataFrame) -> DataFrame:
    """(onset, r, n): the mean rank and the number of places of each distinct onset; a row a period."""
    tied = running(onset.groupBy("onset").agg(F.count("*").alias("n")), ["onset"], {"_upto": F.col("n")})
    return tied.select("onset", (F.col("_upto") - (F.col("n") - 1) / 2).alias("r"), "n")


def wave_scores(onset: DataFrame, distance: DataFrame, *, least: int = LEAST) -> DataFrame:
    """(source, score, places, rho, radius): the disc around each source in which onset follows distance most clearly.

    distance: source, u, d. rho is Spearman's correlation of onset (ranked among all places) and distance (ranked within
    the disc), both with mean ranks for ties; a disc takes all places of a distance or none, so its sums are those of
    distances, running outwards. The score is Fisher's z of rho times sqrt(places - 3). Discs of fewer than ``least``
    places have none; between equal scores the larger disc counts.
    """
    rows = distance.join(onset.join(_levels(onset).select("onset", "r"), "onset"), "u")
    rings = rows.groupBy("source", "d").agg(F.count("*").alias("m"), F.sum("r").alias("sr"), F.sum(F.col("r") ** 2).alias("srr"))
    out = W.partitionBy("source").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    rings = rings.withColumn("n", F.sum("m").over(out)).withColumn("k", F.col("n") - (F.col("m") - 1) / 2)
    parts = {"sr": F.col("sr"), "srr": F.col("srr"), "sk": F.col("m") * F.col("k"), "skk": F.col("m") * F.col("k") ** 2, "srk": F.col("sr") * F.col("k")}
    rings = rings.withColumns({f"_{name}": F.sum(e).over(out) for name, e in parts.items()}).where(F.col("n") >= max(least, 4))
    mean = lambda name: F.col(f"_{name}") / F.col("n")
    spread = (mean("srr") - mean("sr") ** 2) * (mean("skk") - mean("sk") ** 2)
    rho = F.when(spread > 1e-9, (mean("srk") - mean("sr") * mean("sk")) / F.sqrt(spread)).otherwise(F.lit(0.0))
    rings = rings.withColumn("rho", rho).withColumn("score", F.round(_fisher(F.col("rho")) * F.sqrt(F.col("n") - 3), 9))
    best = F.struct("score", "n")
    return rings.groupBy("source").agg(F.max("score").alias("score"), F.max_by("n", best).cast("int").alias("places"), F.max_by("rho", best).alias("rho"), F.max_by("d", best).alias("radius"))


def _fisher(rho: Column) -> Column:
    near = F.least(F.lit(NEARLY_ONE), F.greatest(F.lit(-NEARLY_ONE), rho))
    return F.log((1 + near) / (1 - near)) / 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits well mixed."""
    for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def surrogate_maxima(onset: DataFrame, distance: DataFrame, *, surrogates: int = SURROGATES, seed: str = "waves", least: int = LEAST) -> DataFrame:
    """(r, score): the best score of any source and disc when every place draws its onset anew from the places' onsets.

    A place's draw in surrogate r depends on the place and r alone, so all tasks see the same map without having it. What
    goes to the tasks is the distribution of onsets, a number for each period. A source is one row with its places by
    distance; batches of sources send one maximum for each surrogate.
    """
    levels = np.array([[r.r, r.n] for r in _levels(onset).orderBy("onset").collect()], float).reshape(-1, 2)
    upto = levels[:, 1].cumsum()
    known = distance.join(onset.select("u"), "u")
    discs = known.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("d", F.xxhash64(F.lit(seed), "u").alias("h")))).alias("s")).select(F.col("s.d").alias("d"), F.col("s.h").alias("h"))
    salt = _mixed(np.arange(1, surrogates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def one(d: np.ndarray, h: np.ndarray) -> np.ndarray | None:
        ends = np.flatnonzero(np.append(d[1:] != d[:-1], True)) + 1  # places up to the end of each distance
        many = np.diff(ends, prepend=0)
        ranks = np.repeat(ends - (many - 1) / 2, many)
        ends = ends[ends >= max(least, 4)]
        if not len(ends):
            return None
        sk, skk = (ranks.cumsum()[ends - 1] / ends, (ranks * ranks).cumsum()[ends - 1] / ends)
        best = []
        for low in range(0, surrogates, 128):
            draw = _mixed(h.view(np.uint64)[None, :] ^ salt[low : low + 128, None])
            r = levels[np.minimum(np.searchsorted(upto, (draw >> np.uint64(11)) * (upto[-1] / 2.0**53), side="right"), len(upto) - 1), 0]
            at = lambda x: x.cumsum(axis=1)[:, ends - 1] / ends
            sr = at(r)
            spread = (at(r * r) - sr * sr) * (skk - sk * sk)
            rho = np.where(spread > 1e-9, (at(r * ranks) - sr * sk) / np.sqrt(np.maximum(spread, 1e-9)), 0.0)
            best.append((np.arctanh(np.clip(rho, -NEARLY_ONE, NEARLY_ONE)) * np.sqrt(ends - 3)).max(axis=1))
        return np.concatenate(best)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = np.full(surrogates, -np.inf)
        for frame in frames:
            for d, h in zip(frame["d"], frame["h"]):
                if (own := one(np.asarray(d, float), np.asarray(h, np.int64))) is not None:
                    top = np.maximum(top, own)
        yield pd.DataFrame({"r": np.arange(surrogates), "score": top})

    return discs.mapInPandas(work, "r int, score double").groupBy("r").agg(F.max("score").alias("score"))


def best_wave(onset: DataFrame, distance: DataFrame, *, surrogates: int = SURROGATES, seed: str = "waves", least: int = LEAST) -> DataFrame:
    """The source and disc of largest score, with its p among the maxima of ``surrogate_maxima``."""
    own = wave_scores(onset, distance, least=least).orderBy(F.desc("score"), "source").limit(1)
    null = surrogate_maxima(onset, distance, surrogates=surrogates, seed=seed, least=least).withColumnRenamed("score", "_null")
    beaten = own.crossJoin(null)  # own is one row
    return beaten.groupBy(*own.columns).agg(((1 + F.sum((F.col("_null") >= F.col("score") - 1e-9).cast("int"))) / F.lit(1.0 + surrogates)).alias("p"))


def waves(onset: DataFrame, distance: DataFrame, *, q: float = 0.05, surrogates: int = SURROGATES, seed: str = "waves", least: int = LEAST, most: int = MAX_WAVES) -> DataFrame:
    """Successive waves, each sought among the places that earlier ones left, until one's p exceeds ``q``; that one is given too.

    slope: of the least-squares line of onset on distance over a wave's disc; a wave whose line doesn't rise isn't
    ``found``. A found wave takes the places of its disc within two standard deviations (of half a period at least) of the
    line, and they neither depart nor serve as sources again. Only one row a wave comes to the driver.
    """
    spark = onset.sparkSession
    left = staged(onset.select("u", F.col("onset").cast("double").alias("onset")), "onset")
    pairs = staged(distance.select("source", "u", F.col("d").cast("double").alias("d")), "distance")
    rows = []
    for number in range(1, most + 1):
        best = best_wave(left, pairs, surrogates=surrogates, seed=f"{seed}:{number}", least=least).first()
        if best is None:
            break
        disc = pairs.where((F.col("source") == best.source) & (F.col("d") <= best.radius)).join(left, "u")
        line = disc.agg(F.coalesce(F.regr_slope("onset", "d"), F.lit(0.0)).alias("b"), F.coalesce(F.regr_intercept("onset", "d"), F.avg("onset")).alias("a")).first()
        off = F.col("onset") - line.a - line.b * F.col("d")
        found = best.p <= q and line.b > 0
        rows.append((number, best.source, best.score, best.places, best.rho, best.radius, best.p, line.b, found))
        if not found:
            break
        sd = disc.agg(F.sqrt(F.avg(off * off)).alias("s")).first().s
        members = staged(disc.where(F.abs(off) <= SPREAD * max(sd, LEAST_SD)).select("u"), "wave")
        left = staged(left.join(members, "u", "left_anti"), "onset")
        pairs = staged(pairs.join(members, "u", "left_anti").join(members.withColumnRenamed("u", "source"), "source", "left_anti"), "distance")
    return spark.createDataFrame(rows, f"wave int, source {dict(distance.dtypes)['source']}, score double, places int, rho double, radius double, p double, slope double, found boolean")


def speed(onset: DataFrame, distance: DataFrame) -> DataFrame:
    """Distance over delay, the median of a source's places that depart after it."""
    own = onset.select(F.col("u").alias("source"), F.col("onset").alias("start"))
    rows = distance.join(onset, "u").join(own, "source").where("onset > start")
    return rows.groupBy("source").agg(F.median(F.col("d") / (F.col("onset") - F.col("start"))).alias("speed"))
