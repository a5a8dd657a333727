"""Departures of counts from their expectation: cells, windows, steps, sets of places, shares and groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.functions import distributions as d
from cellweave.functions.tails import nb_upper
from cellweave.operators.error_control import bh
from cellweave.operators.ranking import running

RATE_RATIO = 1.1


def capped_ratio(ratio: float, mu: Column, mean: Column) -> Column:
    """The relevant rate ratio: less for cells of large burden, so that one cell's excess is that of a mean cell."""
    return F.least(F.lit(ratio), 1 + F.lit(ratio - 1) * mean / mu)


def rate_ratio() -> Column:
    return (F.col("y") + 0.5) / (F.col("mu") + 0.5)


def outbreak(cells: DataFrame, q: float, *, ratio: float = RATE_RATIO, keys: tuple[str, ...] = ("u", "year")) -> DataFrame:
    """p = P(Y >= y) at the relevant multiple of mu, weighted BH with weight mu over its mean. cells: keys, y, mu, phi."""
    mean = cells.agg(F.avg("mu").alias("_mean"))
    rows = cells.crossJoin(mean)  # one row
    rows = rows.withColumn("theta", capped_ratio(ratio, F.col("mu"), F.col("_mean")))
    rows = rows.withColumns({"p": nb_upper("y", F.col("theta") * F.col("mu"), "phi"), "ratio": rate_ratio(), "id": F.concat_ws(":", *[F.col(k).cast("string") for k in keys])})
    return bh(rows.drop("_mean"), q, weight="mu")


def windows(cells: DataFrame, *, least_past: int = 3, shortest: int = 2) -> DataFrame:
    """Suffix sums of each place: observed and expected from t on, for every t with enough past and length."""
    after = W.partitionBy("u").orderBy("year").rowsBetween(0, W.unboundedFollowing)
    past = W.partitionBy("u").orderBy("year")
    rows = cells.withColumns({"y_after": F.sum("y").over(after), "mu_after": F.sum("mu").over(after), "v_after": F.sum(F.col("mu") ** 2 / F.col("phi")).over(after), "length": F.count("*").over(after), "past": F.row_number().over(past) - 1})
    return rows.where((F.col("past") >= least_past) & (F.col("length") >= shortest))


def change_point(cells: DataFrame, q: float, *, ratio: float = RATE_RATIO) -> DataFrame:
    """Per place the least trailing-window tail times the number of windows; BH over places."""
    rows = windows(cells).withColumn("phi_after", F.col("mu_after") ** 2 / F.col("v_after"))
    rows = rows.withColumn("p_window", nb_upper("y_after", F.lit(ratio) * F.col("mu_after"), "phi_after"))
    per = rows.groupBy("u").agg(F.least(F.lit(1.0), F.min("p_window") * F.count("*")).alias("p"), F.min_by("year", F.struct("p_window", "year")).alias("since"))
    return bh(per.withColumn("id", F.col("u")), q).drop("id")


def scan_score(y: Column, m: Column) -> Column:
    """Y ln(Y / M) + M - Y where Y exceeds M, else 0."""
    return F.when((y > m) & (m > 0), y * F.log(y / m) + m - y).otherwise(F.lit(0.0))


def window_scores(cells: DataFrame, *, longest: int) -> DataFrame:
    """Score of every contiguous window of up to ``longest`` periods of each place: a bounded fan-out of each row."""
    lengths = cells.withColumn("length", F.explode(F.sequence(F.lit(1), F.lit(longest))))
    ends = lengths.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("length") - 1))).withColumn("start", F.col("year") - F.col("_k"))
    total = ends.groupBy("u", "start", "length").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"), F.count("*").alias("_n")).where("_n = length").drop("_n")
    return total.withColumn("score", scan_score(F.col("y"), F.col("mu")))


def best_prefixes(cells: DataFrame, *, within: tuple[str, ...]) -> DataFrame:
    """The subset of places that scores highest in each group: a prefix of the places by y / mu (linear-time subset scan)."""
    order = W.partitionBy(*within).orderBy((F.col("y") / F.col("mu")).desc(), "u")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = cells.where("mu > 0").withColumns({"sy": F.sum("y").over(upto), "sm": F.sum("mu").over(upto), "size": F.row_number().over(order)})
    rows = rows.withColumn("score", scan_score(F.col("sy"), F.col("sm")))
    return rows.groupBy(*within).agg(F.max("score").alias("score"), F.max_by("size", F.struct("score", -F.col("size"))).alias("size"))


def gumbel_fit(x: np.ndarray) -> tuple[float, float]:
    """Location and scale of largest likelihood, by bisection of the scale's equation."""
    x = np.asarray(x, float)
    z = x - x.min()
    low, high = 1e-12 * max(np.ptp(x), 1e-12), 10 * np.ptp(x)
    for _ in range(200):
        s = (low + high) / 2
        w = np.exp(-z / s)
        low, high = (low, s) if s - z.mean() + (z * w).sum() / w.sum() > 0 else (s, high)
    return float(x.min() - s * np.log(np.exp(-z / s).mean())), float(s)


MIN_POSITIVE, MAX_REPLICATES, BLOCK = 20, 2000, 25


def space_time(cells: DataFrame, neighbourhoods: DataFrame, *, longest: int = 4, replicates: int = 200, alpha: float = 0.05, most: int = 20, seed: int = 0) -> DataFrame:
    """Best subset of each centre's neighbourhood and window, and the subsets that are reported one after the other.

    cells: u, year, y, mu, phi. neighbourhoods: centre, u (itself included), at most a few dozen places each.
    The first scan gives a row for every centre. The best of all is reported (``reported`` = 1) where its p is at most
    ``alpha``; its cells are then expected as observed where that is more, all centres are scanned again, and so on to
    ``most`` subsets. Those of later scans (``reported`` = 2 ...) are rows of their own.

    p is (1 - pi0) times a Gumbel tail fitted to the replicates' positive maxima, pi0 the share of maxima at zero.
    Replicates are doubled, up to MAX_REPLICATES, until MIN_POSITIVE maxima are positive; without these every p is 1.
    A task has one centre's neighbourhood and a block of replicates; a place's counts in a block are drawn alike in every
    task, so maxima over centres are those of one simulated map.
    """
    from cellweave.sources.scratch import staged

    joined = staged(neighbourhoods.join(cells, "u").select(F.col("centre").cast("long"), "u", "year", F.col("y").cast("double"), F.col("mu").cast("double"), F.col("phi").cast("double")), "scan")

    def table_of(frame: pd.DataFrame):
        y, m, phi = (frame.pivot(index="u", columns="year", values=v).sort_index().fillna(0.0) for v in ("y", "mu", "phi"))
        n = len(y.columns)
        return y, m.to_numpy(float), phi.to_numpy(float), [(a, b) for a in range(n) for b in range(a + 1, min(n, a + longest) + 1)]

    def prefixes(y: np.ndarray, m: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and orders (map, span, prefix) of maps y (map, place, year): places by y / mu in each span."""
        first, last = np.array(spans).T
        sums = lambda x: (c := np.concatenate([np.zeros(x.shape[:-1] + (1,)), x.cumsum(-1)], -1))[..., last] - c[..., first]
        sy, sm = sums(y).swapaxes(1, 2), np.broadcast_to(sums(m).T, (len(y), len(spans), len(m)))
        order = np.argsort(-sy / np.maximum(sm, 1e-12), axis=2, kind="stable")
        cy, cm = np.take_along_axis(sy, order, 2).cumsum(2), np.take_along_axis(sm, order, 2).cumsum(2)
        return np.where(cy > cm, cy * np.log(np.maximum(cy, 1e-12) / np.maximum(cm, 1e-12)) + cm - cy, 0), order

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        y, m, _, spans = table_of(frame)
        score, order = prefixes(y.to_numpy(float)[None], m, spans)
        at, k = np.unravel_index(int(np.argmax(score[0] >= score.max() - 1e-12)), score[0].shape)
        (a, b), best = spans[at], float(score.max())
        places = [int(x) for x in sorted(y.index.to_numpy()[order[0, at, : k + 1]])] if best > 0 else []
        return pd.DataFrame([(int(frame["centre"].iat[0]), best, int(y.columns[a]), int(y.columns[b - 1]), places)], columns=["centre", "score", "first", "last", "places"])

    def simulated(frame: pd.DataFrame) -> pd.DataFrame:
        y, m, phi, spans = table_of(frame)
        reps, drawn = sorted(frame["reps"].iat[0]), []
        for u, f, x in zip(y.index, np.maximum(phi, 1e-9), np.maximum(m, 0)):  # one generator for a place and block
            rng, size = np.random.default_rng([seed, int(reps[0]), int(u)]), (len(reps), len(x))
            drawn.append(rng.poisson(x * rng.gamma(f, 1 / f, size)))
        return pd.DataFrame({"replicate": reps, "top": prefixes(np.stack(drawn, 1).astype(float), m, spans)[0].max((1, 2))})

    def maxima(low: int, high: int) -> np.ndarray:
        blocks = joined.sparkSession.range(0, -(-(high - low) // BLOCK)).select("id", F.expr(f"sequence({low} + id * {BLOCK}, least({high}, {low} + (id + 1) * {BLOCK}) - 1)").alias("reps"))
        rows = joined.crossJoin(F.broadcast(blocks)).groupBy("centre", "id").applyInPandas(simulated, "replicate long, top double")  # at most 80 blocks
        return np.array([r["top"] for r in rows.groupBy("replicate").agg(F.max("top").alias("top")).orderBy("replicate").collect()])

    found = "centre long, score double, first long, last long, places array<long>"
    every = staged(joined.groupBy("centre").applyInPandas(scan, found), "scanned")
    null = maxima(0, replicates)
    while (null > 0).sum() < MIN_POSITIVE and 0 < len(null) < MAX_REPLICATES:
        null = np.append(null, maxima(len(null), min(2 * len(null), MAX_REPLICATES)))
    positive = null[null > 0]
    fitted = len(positive) >= MIN_POSITIVE and np.ptp(positive) > 0
    loc, scale = gumbel_fit(positive) if fitted else (0.0, 1.0)
    share = len(positive) / max(len(null), 1)

    def p_of(score: float) -> float:
        return float(-share * np.expm1(-np.exp(-(score - loc) / scale))) if fitted and score > 0 else 1.0

    rows, now = [], every
    while len(rows) < most and (top := now.orderBy(F.desc("score"), "centre").first()) and p_of(top["score"]) <= alpha:
        rows.append((*top, len(rows) + 1))
        if len(rows) < most:
            taken = joined.sparkSession.createDataFrame([(u, t) for r in rows for u in r[4] for t in range(r[2], r[3] + 1)], "u long, year long").distinct().withColumn("_in", F.lit(True))
            freed = joined.join(F.broadcast(taken), ["u", "year"], "left").withColumn("mu", F.when(F.col("_in"), F.greatest("mu", "y")).otherwise(F.col("mu"))).drop("_in")
            now = staged(freed.groupBy("centre").applyInPandas(scan, found), "scanned")
    first = every.withColumn("reported", F.when(F.col("centre") == rows[0][0], 1) if rows else F.lit(None).cast("int"))
    later = joined.sparkSession.createDataFrame(rows[1:], f"{found}, reported int")
    tail = F.when(F.col("score") > 0, -share * F.expm1(-F.exp(-(F.col("score") - loc) / scale))).otherwise(1.0) if fitted else F.lit(1.0)
    return first.union(later).withColumn("p", tail)


def cell_excess(surprises: DataFrame, q: float, *, classes: int = 10) -> DataFrame:
    """Cells above an empirical null of their size class: centre and spread of the class's z (spread at least 1), one BH.

    Classes hold cells of like mu; their centre is the median, their spread that of the middle half.
    """
    edges = surprises.agg(F.percentile_approx("mu", F.array(*[F.lit(i / classes) for i in range(1, classes)]), F.lit(10_000)).alias("_e"))
    rows = surprises.crossJoin(edges).withColumn("class", F.size(F.filter("_e", lambda x: x < F.col("mu")))).drop("_e")  # edges are one row
    null = rows.groupBy("class").agg(F.percentile_approx("z", F.lit(0.5), F.lit(10_000)).alias("_c"), ((F.percentile_approx("z", F.lit(0.75), F.lit(10_000)) - F.percentile_approx("z", F.lit(0.25), F.lit(10_000))) / 1.349).alias("_s"))
    rows = rows.join(null, "class").withColumn("z0", (F.col("z") - F.col("_c")) / F.greatest("_s", F.lit(1.0)))
    from cellweave.functions.tails import normal_two_sided

    two = normal_two_sided("z0")
    rows = rows.withColumn("_two", two).withColumn("p", F.when(F.col("z0") > 0, F.col("_two") / 2).otherwise(1 - F.col("_two") / 2))
    return bh(rows.withColumn("id", F.concat_ws(":", "u", "year")).drop("_c", "_s", "_two"), q).drop("id")


def steps(cells: DataFrame, *, least_past: int = 2, prior: float = 0.05, sd: float = 1.0) -> DataFrame:
    """Posterior of one change of level in each place's series: year, log size, probability that there is any.

    Each year's evidence is a normal approximation to log(Y / M) after it against before; prior N(0, sd**2), all years alike.
    """
    before = W.partitionBy("u").orderBy("year").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("u").orderBy("year").rowsBetween(0, W.unboundedFollowing)
    rows = cells.withColumns({"yb": F.sum("y").over(before), "mb": F.sum("mu").over(before), "ya": F.sum("y").over(after), "ma": F.sum("mu").over(after), "k": F.count("*").over(before)})
    rows = rows.where(F.col("k") >= least_past)
    d_ = F.log((F.col("ya") + 0.5) / (F.col("ma") + 0.5)) - F.log((F.col("yb") + 0.5) / (F.col("mb") + 0.5))
    v = 1 / (F.col("ya") + 0.5) + 1 / (F.col("yb") + 0.5)
    rows = rows.withColumns({"d": d_, "v": v})
    rows = rows.withColumn("bf", F.sqrt(F.col("v") / (F.col("v") + sd * sd)) * F.exp(F.least(F.lit(500.0), F.col("d") ** 2 / 2 * (1 / F.col("v") - 1 / (F.col("v") + sd * sd)))))
    per = rows.groupBy("u").agg(F.avg("bf").alias("bf"), F.max_by("year", F.struct("bf", -F.col("year"))).alias("since"), F.max_by(F.col("d") * sd * sd / (F.col("v") + sd * sd), F.struct("bf", -F.col("year"))).alias("size"))
    return per.select("u", "since", "size", (prior * F.col("bf") / (prior * F.col("bf") + 1 - prior)).alias("posterior"))


def bayes_selected(found: DataFrame, q: float, *, posterior: str = "posterior", id: str = "u") -> DataFrame:
    """The largest set, by decreasing posterior, whose mean posterior null is at most q."""
    rows = running(found, [F.desc(posterior), F.asc(id)], {"_null": 1 - F.col(posterior), "_k": F.lit(1)})
    return rows.withColumn("selected", F.col("_null") / F.col("_k") <= q).drop("_null", "_k")


def central_theta(cells: DataFrame) -> DataFrame:
    """theta of a beta-binomial by central matching: the middle half's spread of (y - n p) / sqrt(n p (1 - p)) at the mean n.

    cells: y, n, share. One row; 1e6 where the middle spreads no more than a binomial's.
    """
    z = (F.col("y") - F.col("n") * F.col("share")) / F.sqrt(F.col("n") * F.col("share") * (1 - F.col("share")))
    rows = cells.where("share > 0 and share < 1").select(z.alias("z"), "n")
    s = ((F.percentile("z", F.lit(0.75)) - F.percentile("z", F.lit(0.25))) / 1.349) ** 2
    out = rows.agg(s.alias("s"), F.avg("n").alias("n"))
    return out.select(F.when(F.col("s") > 1, F.greatest(F.lit(1.0), (F.col("n") - 1) / (F.col("s") - 1) - 1)).otherwise(F.lit(1e6)).alias("theta"))


def share_excess(cells: DataFrame, q: float, *, least: int = 20, ratio: float = 1.25) -> DataFrame:
    """Parts of totals two-sided against a beta-binomial around the expected share. cells: u, year, y, n, share.

    Tails are sums over counts, of many cells at once; for totals beyond 100,000 they are a normal's with a half added.
    """

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            y, n, s, theta = (f[c].to_numpy(float) for c in ("y", "n", "share", "theta"))
            s = np.clip(s, 1e-9, 1 - 1e-9)
            sd = np.sqrt(n * s * (1 - s) * (1 + (n - 1) / (theta + 1)))
            low, high = d.normal_cdf((y + 0.5 - n * s) / sd), d.normal_sf((y - 0.5 - n * s) / sd)
            exact = np.flatnonzero(n <= 100_000)
            for part in np.split(exact, np.flatnonzero(np.diff(np.cumsum(n[exact] + 1) // 1_000_000)) + 1):
                size = (n[part] + 1).astype(int)
                of = np.repeat(np.arange(len(part)), size)
                k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                m, a, b = n[part][of], (s * theta)[part][of], ((1 - s) * theta)[part][of]
                p = np.exp(d.betabinom_logpmf(k.astype(float), m, a, b))
                low[part] = np.bincount(of, p * (k <= y[part][of]), len(part))
                high[part] = np.bincount(of, p * (k >= y[part][of]), len(part))
            yield f.assign(p=np.minimum(1.0, 2 * np.minimum(low, high)))

    rows = cells.where(F.col("n") >= least).select("u", "year", F.col("y").cast("long"), F.col("n").cast("long"), F.col("share").cast("double"))
    rows = rows.crossJoin(central_theta(rows))  # one row
    tested = rows.mapInPandas(tails, "u int, year int, y long, n long, share double, theta double, p double")
    r = (F.col("y") + 0.5) / (F.col("n") * F.col("share") + 0.5)
    out = bh(tested.withColumn("id", F.concat_ws(":", "u", "year")).withColumn("ratio", r), q)
    return out.withColumn("found", F.col("rejected") & ((F.col("ratio") >= ratio) | (F.col("ratio") <= 1 / ratio))).drop("id", "rejected")


def joint_scores(cells: DataFrame, *, least_fields: int = 2) -> DataFrame:
    """Per place and period the best set of fields, a prefix by y / mu. cells: field, u, year, y, mu."""
    order = W.partitionBy("u", "year").orderBy((F.col("y") / F.col("mu")).desc(), "field")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = cells.where("mu > 0").withColumns({"sy": F.sum("y").over(upto), "sm": F.sum("mu").over(upto), "k": F.row_number().over(order)})
    rows = rows.withColumn("score", scan_score(F.col("sy"), F.col("sm"))).where(F.col("k") >= least_fields)
    return rows.groupBy("u", "year").agg(F.max("score").alias("score"), F.max_by("k", F.struct("score", -F.col("k"))).alias("fields"))


def group_spread(cells: DataFrame, *, least: float = 5.0) -> DataFrame:
    """G**2 of groups' ratios within each place; groups expected below ``least`` are pooled. cells: u, g, y, mu."""
    pooled = cells.withColumn("g", F.when(F.col("mu") >= least, F.col("g").cast("string")).otherwise("pooled")).groupBy("u", "g").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"))
    w = W.partitionBy("u")
    rows = pooled.withColumn("e", F.col("mu") * F.sum("y").over(w) / F.sum("mu").over(w))
    term = F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / F.col("e"))).otherwise(0.0) - (F.col("y") - F.col("e"))
    return rows.groupBy("u").agg((2 * F.sum(term)).alias("g2"), (F.count("*") - 1).alias("df"))


def trends(cells: DataFrame, *, unit: str = "u") -> DataFrame:
    """Slope of log((y + 1/2) / (mu + 1/2)) on the year, weighted by mu, and its standard deviation."""
    x, r, w = F.col("year").cast("double"), F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)), F.col("mu")
    s = cells.groupBy(unit).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * r).alias("wr"), F.sum(w * x * r).alias("wxr"), F.sum(w * x * x).alias("wxx"))
    den = F.col("wxx") - F.col("wx") ** 2 / F.col("w")
    return s.select(unit, ((F.col("wxr") - F.col("wx") * F.col("wr") / F.col("w")) / den).alias("beta"), F.sqrt(1 / den).alias("sd"))


def divergence(slopes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each unit's slope less its neighbours' mean; variance sd**2 + sum(sd_j**2) / degree**2. edges: a, b both ways."""
    n = slopes.withColumnsRenamed({"u": "b", "beta": "bj", "sd": "sj"})
    around = edges.join(n, "b").groupBy("a").agg(F.avg("bj").alias("near"), (F.sum(F.col("sj") ** 2) / F.count("*") ** 2).alias("vj"))
    rows = slopes.join(around.withColumnRenamed("a", "u"), "u")
    return rows.select("u", (F.col("beta") - F.col("near")).alias("difference"), F.sqrt(F.col("sd") ** 2 + F.col("vj")).alias("sd"))


def harmonics(cells: DataFrame) -> DataFrame:
    """Yearly sine and cosine of each unit's monthly ratio, weighted alike. cells: u, year, month, y, mu; whole years only."""
    a = F.lit(2 * math.pi) * (F.col("month") - 1) / 12
    r = F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5))
    return cells.groupBy("u", "year").agg((F.sum(r * F.sin(a)) / 6).alias("sin"), (F.sum(r * F.cos(a)) / 6).alias("cos"), F.count("*").alias("months")).where("months = 12").drop("months")


def season_departure(yearly: DataFrame) -> DataFrame:
    """Each unit's own season, its years taken as random: amplitude, phase in months, F statistic and p. yearly: u, year, sin, cos.

    The statistic is the mean harmonic's square over the spread between years, on 2 and 2 (years - 1) degrees of freedom.
    """
    from cellweave.functions.tails import f_upper

    k = F.count("*")
    size = F.avg("sin") ** 2 + F.avg("cos") ** 2
    spread = (F.var_samp("sin") + F.var_samp("cos")) / 2
    per = yearly.groupBy("u").agg(k.alias("years"), F.sqrt(size).alias("amplitude"), (F.atan2(F.avg("sin"), F.avg("cos")) * 6 / math.pi).alias("phase"), (k * size / (2 * spread)).alias("f"))
    return per.where("years >= 4").withColumn("p", f_upper("f", F.lit(2.0), (2.0 * (F.col("years") - 1)).cast("double")))


def institution_windows(cells: DataFrame, *, least: float = 27.0, ratio: float = 1.6) -> DataFrame:
    """Each facility's contiguous years of largest likelihood ratio against its constant ratio. cells: facility, year, y, mu.

    A facility has a row a year; pairs of its years meet by a join on the facility.
    """
    w = W.partitionBy("facility").orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    cum = cells.withColumns({"cy": F.sum("y").over(w), "cm": F.sum("mu").over(w)})
    every = W.partitionBy("facility")
    cum = cum.withColumns({"ty": F.sum("y").over(every), "tm": F.sum("mu").over(every)})
    start = cum.select("facility", F.col("year").alias("first"), (F.col("cy") - F.col("y")).alias("by"), (F.col("cm") - F.col("mu")).alias("bm"))
    spans = cum.join(start, "facility").where("first <= year").withColumns({"o": F.col("cy") - F.col("by"), "m": F.col("cm") - F.col("bm")})
    e = F.col("m") * F.col("ty") / F.col("tm")
    spans = spans.withColumns({"e": e, "r": (F.col("o") + 0.5) / (e + 0.5)})
    llr = lambda o, e: F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)
    g = 2 * (llr(F.col("o"), F.col("e")) + llr(F.col("ty") - F.col("o"), F.col("ty") - F.col("e")))
    best = spans.withColumn("g", g).groupBy("facility").agg(F.max(F.struct("g", -F.col("first"), "year", "r")).alias("b"))
    out = best.select("facility", F.col("b.g").alias("g"), (-F.col("b")["col2"]).alias("first"), F.col("b.year").alias("last"), F.col("b.r").alias("ratio"))
    return out.withColumn("found", (F.col("g") >= least) & (F.col("ratio") >= ratio))
