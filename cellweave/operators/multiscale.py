"""Departures at every scale of a graph: values averaged step by step over neighbours, peaks over places, scales and windows.

Diffusion is a join with the edges and a sum, repeated; no spectrum is computed, and simulated maps are further rows of the
same tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cellweave.operators.courses import grid_of, matrix, series
from cellweave.sources.scratch import staged


def diffused(values: DataFrame, edges: DataFrame, keys: list[str], steps: list[int]) -> DataFrame:
    """(scale, u, keys..., x): ``values`` (u, keys, x) after each number of steps; missing values are 0.

    A step takes half of a place's own value and half of its neighbours' weighted mean; a place without neighbours keeps its
    own. edges: a, b, weight, both ways.
    """
    total = edges.groupBy("a").agg(F.sum("weight").alias("_t"))
    share = edges.join(total, "a").select(F.col("a").alias("u"), F.col("b").alias("v"), (F.col("weight") / F.col("_t") / 2).alias("_w"))
    kept = values.select("u").distinct().join(total.withColumnRenamed("a", "u"), "u", "left").select("u", F.col("u").alias("v"), F.when(F.col("_t").isNull(), 1.0).otherwise(0.5).alias("_w"))
    flow = staged(share.unionByName(kept), "flow")
    now, out, done = values.select("u", *keys, F.col("x").cast("double").alias("x")), None, 0
    for scale in sorted(steps):
        while done < scale:
            now = flow.join(now.withColumnRenamed("u", "v"), "v").groupBy("u", *keys).agg(F.sum(F.col("_w") * F.col("x")).alias("x"))
            now, done = staged(now, "diffused"), done + 1
        level = now.select(F.lit(scale).alias("scale"), "u", *keys, "x")
        out = level if out is None else out.unionByName(level)
    return out


def windows(periods: int, *, suffix_from: int = 2) -> list[tuple[int, int]]:
    """Single periods, and those from some period to the end that leave ``suffix_from`` before and have two at least."""
    return [(t, t) for t in range(periods)] + [(t, periods - 1) for t in range(suffix_from, periods - 1)]


def _fields(cells: DataFrame, replicates: int, seed: int, rho: float) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """(r, u, w, x): sums of y - mu in each window, of the data (r = 0) and of simulated maps; (u, w, mu, v): expectation and variance."""
    grid = np.array(grid_of(cells, "year"))
    spans = windows(len(grid))
    inside = np.array([(np.arange(len(grid)) >= a) & (np.arange(len(grid)) <= b) for a, b in spans], float).T  # periods x windows
    apart = np.abs(np.subtract.outer(np.arange(len(grid)), np.arange(len(grid))))
    corr = rho**apart
    root = np.linalg.cholesky(corr + 1e-9 * np.eye(len(grid)))
    table = staged(series(cells, ["y", "mu", "phi"]), "fields")
    kind = dict(table.dtypes)["u"]

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            y, mu, phi = (matrix(f, c, grid, 1e9 if c == "phi" else 0.0) for c in ("y", "mu", "phi"))
            for i, u in enumerate(f["u"]):
                rnd = np.random.default_rng([seed, int(u) & 0xFFFFFFFF])
                # log-normal with the gamma's variance and serial correlation rho, then Poisson
                s = np.sqrt(np.log1p(1 / np.maximum(phi[i], 1e-9)))
                noise = np.exp(rnd.standard_normal((replicates, len(grid))) @ root.T * s - s * s / 2)
                x = np.concatenate([y[i : i + 1], rnd.poisson(mu[i] * noise)]) - mu[i]
                sums = x @ inside
                yield pd.DataFrame({"r": np.repeat(np.arange(replicates + 1), len(spans)), "u": u, "w": np.tile(np.arange(len(spans)), replicates + 1), "x": sums.ravel()})

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mu, phi = matrix(f, "mu", grid), matrix(f, "phi", grid, 1e9)
            sd = mu / np.sqrt(np.maximum(phi, 1e-9))
            cov = sd[:, :, None] * sd[:, None, :] * corr + np.eye(len(grid)) * mu[:, :, None]
            v = np.einsum("tw,ust,sw->uw", inside, cov, inside)
            yield pd.DataFrame({"u": np.repeat(f["u"].to_numpy(), len(spans)), "w": np.tile(np.arange(len(spans)), len(f)), "mu": (mu @ inside).ravel(), "v": v.ravel()})

    x = staged(table.mapInPandas(drawn, f"r int, u {kind}, w int, x double"), "maps")
    m = staged(table.mapInPandas(moments, f"u {kind}, w int, mu double, v double"), "moments")
    return x, m, [(int(grid[a]), int(grid[b])) for a, b in spans]


def peaks(cells: DataFrame, edges: DataFrame, *, scales: list[int], replicates: int = 40, seed: int = 0, rho: float = 0.0) -> DataFrame:
    """(u, scale, first, last, z, ratio, p): places whose best departure over scales and windows exceeds all neighbours' best.

    cells: u, year, y, mu, phi; edges: a, b, weight, both ways; scales: steps of diffusion. At each scale a window's sum of
    y - mu around a place is divided by its standard deviation under the expectation, and then by the simulated maps' median
    and spread at that scale and window. ratio: of the averaged counts to the expectation. p: the rank of a peak among the peaks
    of the same scale in ``replicates`` simulated maps, which go through the same steps side by side; one where no map
    has a peak of the scale. Between equal neighbours the smaller place is the peak.
    """
    x, m, spans = _fields(cells, replicates, seed, rho)
    s = diffused(x, edges, ["r", "w"], scales)
    mean = diffused(m.select("u", "w", F.col("mu").alias("x")), edges, ["w"], scales).withColumnRenamed("x", "m")
    one = cells.select("u").distinct()
    kernel = diffused(one.select("u", F.col("u").alias("from"), F.lit(1.0).alias("x")), edges, ["from"], scales)
    var = kernel.join(m.select(F.col("u").alias("from"), "w", "v"), "from").groupBy("scale", "u", "w").agg(F.sum(F.col("x") ** 2 * F.col("v")).alias("v"))
    z = staged(s.join(var, ["scale", "u", "w"]).where("v > 0").withColumn("z", F.col("x") / F.sqrt("v")), "scores")
    null = z.where("r > 0").groupBy("scale", "w").agg(F.percentile_approx("z", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000)).alias("_q"))
    z = z.join(F.broadcast(null), ["scale", "w"])  # a row a scale and window
    z = z.withColumn("z", (F.col("z") - F.col("_q")[1]) / F.greatest(F.lit(0.2), (F.col("_q")[2] - F.col("_q")[0]) / 1.349))
    best = staged(z.groupBy("r", "u").agg(F.max(F.struct("z", -F.col("scale"), -F.col("w"))).alias("b")).select("r", "u", F.col("b.z").alias("z"), (-F.col("b.col2")).alias("scale"), (-F.col("b.col3")).alias("w")), "best")
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
    higher = best.join(around, "u").join(best.select("r", F.col("u").alias("v"), F.col("z").alias("zv")), ["r", "v"]).where((F.col("zv") > F.col("z")) | ((F.col("zv") == F.col("z")) & (F.col("v") < F.col("u"))))
    top = staged(best.join(higher.select("r", "u"), ["r", "u"], "left_anti"), "peaks")
    # the rank of each observed peak among the simulated ones of its scale, by running counts from the largest down
    w = W.partitionBy("scale").orderBy(F.desc("z"), F.desc("r"))
    sim = (F.col("r") > 0).cast("int")
    ranked = top.withColumns({"_above": F.sum(sim).over(w.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum(sim).over(W.partitionBy("scale"))}).where("r = 0")
    rows = ranked.withColumn("p", (1 + F.col("_above")) / (1 + F.col("_all"))).join(s.where("r = 0").select("scale", "u", "w", "x"), ["scale", "u", "w"]).join(mean, ["scale", "u", "w"])
    when = F.broadcast(cells.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "w int, first int, last int"))  # the windows
    return rows.join(when, "w").select("u", "scale", "first", "last", "z", ((F.col("x") + F.col("m")) / F.col("m")).alias("ratio"), "p")


def footprints(found: DataFrame, cells: DataFrame, edges: DataFrame, *, mass: float = 0.5) -> DataFrame:
    """(centre, scale, first, last, u, share): the fewest places that carry ``mass`` of a peak.

    found: u, scale, first, last. A place counts with its part in the peak's average times its events above expectation in
    the window; where none has any, with its part alone. Places are taken from the largest down, ties by place.
    """
    scales = [r[0] for r in found.select("scale").distinct().collect()]  # the few scales
    if not scales:
        return found.select(F.col("u").alias("centre"), "scale", "first", "last", "u", F.lit(0.0).alias("share"))
    kernel = diffused(cells.select("u").distinct().select("u", F.col("u").alias("from"), F.lit(1.0).alias("x")), edges, ["from"], scales)
    rows = found.select(F.col("u").alias("centre"), "scale", "first", "last").join(kernel.select("scale", F.col("u").alias("centre"), F.col("from").alias("u"), "x"), ["scale", "centre"])
    key = ["centre", "scale", "first", "last"]
    per = rows.join(cells.select("u", "year", "y", "mu"), "u").where("year BETWEEN first AND last").groupBy(*key, "u", "x").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"))
    per = per.withColumn("e", F.col("x") * F.greatest(F.lit(0.0), F.col("y") - F.col("mu")))
    w = W.partitionBy(*key)
    per = per.withColumn("e", F.when(F.sum("e").over(w) > 0, F.col("e")).otherwise(F.col("x")))
    down = w.orderBy(F.desc("e"), "u").rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumns({"_before": F.sum("e").over(down) - F.col("e"), "_all": F.sum("e").over(w)}).where("e > 0")
    return per.where(F.col("_before") < mass * F.col("_all")).select(*key, "u", (F.col("e") / F.col("_all")).alias("share"))
