"""What chance alone would give: random sets of places on a graph, and series whose rhythm is kept and whose timing isn't."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.operators.graphs import components
from cellweave.sources.scratch import staged

#: Fixed values of the method: tries of a set to reach its size, places that a class must have to be drawn from.
TRIES, LEAST_CLASS = 20, 5


def _drawn(seed: str, n: Column, *keys: str) -> Column:
    """A number from 0 to n - 1 that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), n)


def _numbered(places: DataFrame, keys: list[str], to: str) -> DataFrame:
    """(keys..., to: the place, _i: its number from 0, _n: how many there are) within each class."""
    w = W.partitionBy(*keys)
    return places.select(*keys, F.col("u").alias(to), (F.row_number().over(w.orderBy("u")) - 1).cast("long").alias("_i"), F.count("*").over(w).alias("_n"))


def random_sets(members: DataFrame, places: DataFrame, edges: DataFrame, *, replicates: int = 4999, seed: str = "sets") -> DataFrame:
    """(r, cluster, u): for each replicate as many places as ``members`` (u) has, like them in where they lie.

    places: u, state, quintile; edges: a, b, both ways. Members that touch are a cluster, and each cluster of c places is
    replaced by a random connected set of c, grown from a random place of its state (that of its least member). All
    replicates grow side by side: in a round a set takes places next to it, in the order of a hash, as many as it has (or
    as it still needs), so the number of rounds goes with log c. A set that runs out of neighbours begins anew
    elsewhere, 20 times at most; then random places of the state make it up. A member without a neighbour among them
    (cluster null) is replaced by a random place of its state and quintile, or of its state alone where the class has
    fewer than five places. Rows are replicates times members, never times places.
    """
    own = members.join(places, "u").select("u", "state", "quintile").distinct()
    touch = edges.join(own.select(F.col("u").alias("a")), "a").join(own.select(F.col("u").alias("b")), "b").where("a <> b").select("a", "b")
    spark = own.sparkSession
    e = staged(edges.where("a <> b").select("a", "b").distinct(), "set-edges")
    roots = staged(components(touch), "set-clusters")
    own = staged(own.join(roots.select(F.col("node").alias("u"), F.col("root").alias("cluster")), "u", "left"), "set-members")
    reps = spark.range(1, replicates + 1).select(F.col("id").alias("r"))
    # single members
    single = own.where("cluster IS NULL").join(_numbered(places, ["state", "quintile"], "_x").groupBy("state", "quintile").agg(F.max("_n").alias("_class")), ["state", "quintile"])
    alone = single.select(F.col("u").alias("slot"), "state", F.when(F.col("_class") >= LEAST_CLASS, F.col("quintile")).alias("class"))
    pool = _numbered(places.select("u", "state", F.col("quintile").alias("class")), ["state", "class"], "pick").unionByName(_numbered(places.select("u", "state", F.lit(None).cast(dict(places.dtypes)["quintile"]).alias("class")), ["state", "class"], "pick"))
    pool = staged(pool, "set-pool")
    sizes = pool.groupBy("state", "class").agg(F.max("_n").alias("_n"))
    same = lambda a, b: (a["state"] == b["state"]) & a["class"].eqNullSafe(b["class"])
    draws = alone.join(sizes, same(alone, sizes)).select("slot", alone["state"], alone["class"], "_n").crossJoin(reps)  # members times replicates
    draws = draws.withColumn("_i", _drawn(seed, F.col("_n"), "r", "slot")).drop("_n")
    picked = draws.join(pool.drop("_n"), same(draws, pool) & (draws["_i"] == pool["_i"])).select("r", F.lit(None).cast("long").alias("cluster"), F.col("pick").alias("u"))
    # clusters
    clusters = own.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("size"), F.min_by("state", "u").alias("state"))
    home = staged(clusters.join(sizes.where("class IS NULL").select("state", "_n"), "state"), "set-sizes")
    wanted, done = home.crossJoin(reps).withColumn("try", F.lit(0)), []  # clusters times replicates
    whole_state = pool.where("class IS NULL").select("state", "_i", F.col("pick").alias("u"))
    largest = home.agg(F.max("size")).first()[0] or 0
    for attempt in range(TRIES):
        if largest == 0 or wanted.isEmpty():
            break
        start = wanted.withColumn("_i", _drawn(f"{seed}:{attempt}", F.col("_n"), "r", "cluster"))
        sets = staged(start.join(whole_state, ["state", "_i"]).select("r", "cluster", "size", "u"), "sets")
        have = 1
        while have < largest:
            near = sets.join(e, sets["u"] == e["a"]).select("r", "cluster", "size", F.col("b").alias("u")).distinct()
            near = near.join(sets.select("r", "cluster", "u"), ["r", "cluster", "u"], "left_anti")
            count = sets.groupBy("r", "cluster").agg(F.count("*").alias("_have"))
            order = W.partitionBy("r", "cluster").orderBy(F.xxhash64(F.lit(f"{seed}:{attempt}:{have}"), "r", "cluster", "u"), "u")
            near = near.join(count, ["r", "cluster"]).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.least(F.col("_have"), F.col("size") - F.col("_have")))
            sets = staged(sets.unionByName(near.select(*sets.columns)), "sets")
            have *= 2
        # where neighbours were fewer than a round asked for, rounds go on until nothing more is near
        count = sets.groupBy("r", "cluster", "size").agg(F.count("*").alias("_have"))
        full = staged(count.select("r", "cluster", (F.col("_have") >= F.col("size")).alias("full")), "sets-full")
        done.append(sets.join(full.where("full").select("r", "cluster"), ["r", "cluster"], "left_semi").select("r", "cluster", "u"))
        wanted = wanted.join(full.where("NOT full").select("r", "cluster"), ["r", "cluster"], "left_semi")
    if largest and not wanted.isEmpty():
        rest = wanted.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"))))
        rest = rest.withColumn("_i", _drawn(f"{seed}:rest", F.col("_n"), "r", "cluster", "slot"))
        done.append(rest.join(whole_state, ["state", "_i"]).select("r", "cluster", "u"))
    for part in done:
        picked = picked.unionByName(part.select("r", F.col("cluster").cast("long").alias("cluster"), "u"))
    return picked


def window_ratio(observed: Column, usual: Column) -> Column:
    """log((observed + 1/2) / (usual + 1/2)) of sums."""
    return F.log((F.sum(observed) + 0.5) / (F.sum(usual) + 0.5))


def usual_years(cells: DataFrame, first: int, last: int) -> DataFrame:
    """(u, observed, usual): each place's count in a window of years, and its median year outside times the window's years. cells: u, year, y."""
    inside = F.col("year").between(first, last)
    years = cells.where(inside).select(F.count_distinct("year").alias("_k"))
    per = cells.groupBy("u").agg(F.sum(F.when(inside, F.col("y")).otherwise(0)).alias("observed"), F.coalesce(F.median(F.when(~inside, F.col("y"))), F.lit(0.0)).alias("_m"))
    return per.crossJoin(years).select("u", "observed", (F.col("_m") * F.col("_k")).alias("usual"))  # one row


def corroborated_by(values: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, median, p, replicates): the members' ratio of ``values`` (u, observed, usual) among those of random sets (r, u).

    Nothing observed at the members corroborates nothing: p is 1 then. A place that values doesn't have counts as none.
    """
    value = lambda rows: rows.join(values, "u", "left").na.fill(0, ["observed", "usual"])
    own = value(members.select("u")).agg(window_ratio(F.col("observed"), F.col("usual")).alias("x"), F.sum("observed").alias("_seen"))
    null = value(sets).groupBy("r").agg(window_ratio(F.col("observed"), F.col("usual")).alias("_null"))
    rows = null.crossJoin(own)  # own is one row
    p = (1 + F.sum((F.col("_null") >= F.col("x") - 1e-12).cast("int"))) / (1 + F.count("*"))
    out = rows.groupBy("x", "_seen").agg(F.median("_null").alias("median"), p.alias("p"), F.count("*").alias("replicates"))
    return out.select("x", "median", F.when(F.col("_seen") > 0, F.col("p")).otherwise(1.0).alias("p"), "replicates")


def phase_surrogates(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n series with the amplitudes of x's Fourier components and random phases: its autocorrelation without its timing."""
    half = np.fft.rfft(x - x.mean())
    turn = np.random.default_rng(seed).uniform(0, 2 * np.pi, (n, len(half)))
    turn[:, 0] = 0
    if len(x) % 2 == 0:
        turn[:, -1] = 0
    return np.fft.irfft(half * np.exp(1j * turn), n=len(x)) + x.mean()


def lagged_relations(courses: DataFrame, *, lags: int = 2, replicates: int = 999, seed: str = "phases") -> DataFrame:
    """(support, field, leader, lag, n, rho, p, p_any) for every ordered pair of fields and lag (lag 0 once a pair).

    courses: support, field, region, at, x. Each region's series is centred; rho correlates the field's values with the
    leader's ``lag`` periods before, over the regions that both have. p: among the leader's phase surrogates, the same ones
    for all of a field's pairs; p_any: the largest absolute correlation over the pair's lags among its largest in each
    surrogate. Regions whose periods differ between the two, or with fewer than lags + 3, are left out. A pair is a row
    of two fields' arrays; there are as many as fields squared, whatever the number of places.
    """
    rows = courses.groupBy("support", "field", "region").agg(F.sort_array(F.collect_list(F.struct("at", F.col("x").cast("double").alias("x")))).alias("s"))
    per = rows.groupBy("support", "field").agg(F.sort_array(F.collect_list(F.struct("region", F.col("s.at").alias("at"), F.col("s.x").alias("x")))).alias("s"))
    per = staged(per.select("support", "field", F.col("s.region").cast("array<string>").alias("regions"), F.col("s.at").alias("ats"), F.col("s.x").alias("xs")), "fields")
    other = per.select("support", F.col("field").alias("leader"), F.col("regions").alias("regions2"), F.col("ats").alias("ats2"), F.col("xs").alias("xs2"))
    pairs = per.join(other, "support").where("field <> leader")  # fields squared

    def one(row: pd.Series) -> list[tuple]:
        theirs = {k: (list(a), np.asarray(x, float)) for k, a, x in zip(row.regions2, row.ats2, row.xs2)}
        both = []
        for k, a, x in zip(row.regions, row.ats, row.xs):
            if k in theirs and theirs[k][0] == list(a) and len(a) >= lags + 3:
                y = theirs[k][1]
                both.append((np.asarray(x, float) - np.mean(x), y - y.mean(), zlib.crc32(f"{seed}|{row.support}|{row.leader}|{k}".encode())))
        if not both:
            return []
        drawn = [phase_surrogates(y, replicates, s) for _, y, s in both]
        out = []
        for lag in range(0 if row.field < row.leader else 1, lags + 1):
            a = np.concatenate([x[lag:] for x, _, _ in both])
            b = np.concatenate([y[: len(y) - lag] for _, y, _ in both])
            null = np.concatenate([s[:, : s.shape[1] - lag] for s in drawn], axis=1)
            a, b, null = a - a.mean(), b - b.mean(), null - null.mean(axis=1, keepdims=True)
            corr = lambda v: v @ a / np.maximum(np.sqrt((v * v).sum(axis=-1) * (a @ a)), 1e-300)  # noqa: E731, B023
            out.append((lag, len(a), float(corr(b)), np.abs(corr(null))))
        top, most = np.max([o[3] for o in out], axis=0), max(abs(o[2]) for o in out)
        share = lambda null, x: (1 + int((null >= x - 1e-12).sum())) / (1 + replicates)
        return [(row.support, row.field, row.leader, lag, n, rho, share(null, abs(rho)), share(top, most)) for lag, n, rho, null in out]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["support", "field", "leader", "lag", "n", "rho", "p", "p_any"]
        for frame in frames:
            yield pd.DataFrame([r for row in frame.itertuples() for r in one(row)], columns=names)

    kinds = dict(courses.dtypes)
    return pairs.mapInPandas(work, f"support {kinds['support']}, field {kinds['field']}, leader {kinds['field']}, lag int, n bigint, rho double, p double, p_any double")


def field_courses(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(support, field, region, at, x): log((y + 1/2) / (mu + 1/2)) of yearly sums, of all places and of each region. cells: field, u, year, y, mu; regions: u, region."""
    rows = cells.join(regions, "u")
    each = rows.select(F.lit("regional").alias("support"), "field", F.col("region").cast("string").alias("region"), "year", "y", "mu")
    both = each.unionByName(each.withColumns({"support": F.lit("national"), "region": F.lit("all")}))
    per = both.groupBy("support", "field", "region", F.col("year").cast("long").alias("at")).agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"))
    return per.select("support", "field", "region", "at", F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("x"))
