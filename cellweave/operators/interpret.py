"""Reading findings: decompositions, rivals, honest sizes, replication, corroboration, register and stories."""

from __future__ import annotations

import zlib
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.functions.tails import poisson_interval
from cellweave.operators.ranking import share_not_above


def decomposition(cells: DataFrame) -> DataFrame:
    """Change of events between two periods split into size, place, composition and risk, mean over all 24 orders.

    cells: u, g, n0, y0, n1, y1. n = N * place share * group share within the place; rates y / n.
    """
    p = W.partitionBy("u")
    rows = cells.crossJoin(cells.agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1")))  # one row
    for k in ("0", "1"):
        rows = rows.withColumn(f"of{k}", F.sum(f"n{k}").over(p))
        rows = rows.withColumns({f"s{k}": F.col(f"of{k}") / F.col(f"all{k}"), f"c{k}": F.when(F.col(f"of{k}") > 0, F.col(f"n{k}") / F.col(f"of{k}")).otherwise(0.0), f"r{k}": F.when(F.col(f"n{k}") > 0, F.col(f"y{k}") / F.col(f"n{k}")).otherwise(0.0)})
    parts = ("all", "s", "c", "r")
    named = {"all": "size", "s": "place", "c": "composition", "r": "risk"}

    def value(now: frozenset) -> Column:
        out = F.lit(1.0)
        for x in parts:
            out = out * F.col(f"{x}{'1' if x in now else '0'}")
        return out

    terms = {}
    for x in parts:
        orders = list(permutations(parts))
        seen: dict[frozenset, int] = {}
        for o in orders:
            before = frozenset(o[: o.index(x)])
            seen[before] = seen.get(before, 0) + 1
        terms[named[x]] = sum((F.lit(c / len(orders)) * (value(b | {x}) - value(b)) for b, c in seen.items()), F.lit(0.0))
    return rows.agg(*[F.sum(t).alias(k) for k, t in terms.items()], F.sum(F.col("y1") - F.col("y0")).alias("change"))


def deviance(cells: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    term = F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / F.col("mu"))).otherwise(0.0) - (F.col("y") - F.col("mu"))
    return cells.groupBy(*by).agg((2 * F.sum(term)).alias("deviance"))


def honest_size(cells: DataFrame) -> DataFrame:
    """(Y + 1/2) / (M + 1/2) and the exact Poisson interval of Y over M."""
    i = cells.withColumn("_i", poisson_interval("y"))
    return i.withColumns({"size": (F.col("y") + 0.5) / (F.col("mu") + 0.5), "low": F.col("_i.low") / F.col("mu"), "high": F.col("_i.high") / F.col("mu")}).drop("_i")


def relevel_outside(cells: DataFrame, inside: Column, *, state: str, least: float = 100.0) -> DataFrame:
    """mu times the ratio of sums outside the locus in its state and year, or the nation's where under ``least`` expected."""
    out = F.when(~inside, 1).otherwise(0)
    s, n = W.partitionBy(state, "year"), W.partitionBy("year")
    sy, sm = F.sum(out * F.col("y")).over(s), F.sum(out * F.col("mu")).over(s)
    ny, nm = F.sum(out * F.col("y")).over(n), F.sum(out * F.col("mu")).over(n)
    ratio = F.when(sm >= least, sy / sm).when(nm > 0, ny / nm).otherwise(1.0)
    return cells.withColumn("level", ratio).withColumn("mu", F.col("mu") * F.col("level"))


def triage(leads: DataFrame) -> DataFrame:
    """The first rule that explains each lead away, in order; signal if none does.

    leads: population, gap_years, all_cause_break, population_break, absorbed, absorbed_z, recording_ratio, off, ratio,
    events, facility_share, facilities.
    """
    c = F.col
    cls = F.when((c("population") <= 0) | (c("gap_years") > 0) & (c("population") >= 5000), "denominator")
    cls = cls.when((c("all_cause_break") >= 1.6) | (c("population_break") >= 1.25), "denominator")
    cls = cls.when((c("absorbed") >= 0.75) & (c("absorbed_z") >= 3), "substitution")
    cls = cls.when(c("recording_ratio") >= 3, "recording")
    cls = cls.when((c("off") < 10) | (c("ratio") < 1.5) & (c("ratio") > 1 / 1.5) & (c("events") < 30), "noise")
    cls = cls.when((c("facility_share") >= 0.7) & (c("facilities") <= 3), "facility")
    return leads.withColumn("class", cls.otherwise("signal"))


def corroborated(values: DataFrame, members: DataFrame, *, replicates: int = 4999, seed: str = "sets") -> DataFrame:
    """A set's mean against random sets matched by stratum: p = (1 + sets at least as large) / (1 + replicates).

    values: u, stratum, x. members: u. A replicate draws as many places of each stratum as the set has, none of them twice.
    A stratum is one row with its values; the task that has it draws all its sets and sends their sums, so there are as many
    rows as strata and replicates, whatever the number of places.
    """
    rows = values.join(members.select("u").distinct().withColumn("_in", F.lit(1)), "u", "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    own = rows.where("_in = 1").agg(F.avg("x").alias("x"), F.count("*").alias("_m"))
    strata = rows.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("u", F.col("x").cast("double").alias("x")))).alias("s"), F.sum("_in").alias("k")).where("k > 0")
    strata = strata.select(F.concat_ws(":", F.lit(seed), F.col("stratum").cast("string")).alias("name"), F.col("s.x").alias("x"), "k")

    def draw(frames):
        for f in frames:
            for name, x, k in zip(f["name"], f["x"], f["k"]):
                rnd, x = np.random.default_rng(zlib.crc32(name.encode())), np.asarray(x, float)
                sums = [x[rnd.random((len(r), len(x))).argpartition(k - 1, axis=1)[:, :k]].sum(axis=1) for r in np.array_split(np.arange(replicates), max(1, replicates * len(x) // 1_000_000))]
                yield pd.DataFrame({"r": np.arange(replicates), "sum": np.concatenate(sums)})

    drawn = strata.mapInPandas(draw, "r int, sum double").groupBy("r").agg(F.sum("sum").alias("sum"))
    beaten = F.sum((F.col("sum") / F.col("_m") >= F.col("x") - 1e-12).cast("int"))
    return drawn.crossJoin(own).groupBy("x").agg(((1 + beaten) / F.lit(1 + replicates)).alias("p"))  # own is one row


def lead_rank(q: Column, effect: Column, tier: Column) -> Column:
    """-log10 q * size * (1 + tier)."""
    return -F.log10(F.greatest(q, F.lit(1e-300))) * F.abs(effect) * (1 + tier)


def current(register: DataFrame, *, id: str = "id", at: str = "at") -> DataFrame:
    """Each lead's latest state; ties by all columns' hash."""
    w = W.partitionBy(id).orderBy(F.desc(at), F.xxhash64(*register.columns))
    return register.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stories(leads: DataFrame, components) -> DataFrame:
    """Leads joined where they share a place and their years overlap. leads: id (long), place, first, last.

    Within a place, leads in order of first year begin a new story where they start after all earlier ones have ended;
    stories of a lead with several places are joined by ``components`` (see graphs). A place's leads are never paired.
    """
    w = W.partitionBy("place").orderBy("first", "last", "id")
    ended = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = leads.withColumn("_new", F.coalesce((F.col("first") > ended).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("b", F.min("id").over(W.partitionBy("place", "_run")))
    comp = components(rows.select(F.col("id").alias("a"), "b"))
    ids = leads.select("id").distinct()
    return ids.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("story"))


def disparity(cells: DataFrame, *, reference: str) -> DataFrame:
    """Each group's ratio to the reference in a place against the national one. cells: u, grp, o, e."""
    ref = cells.where(F.col("grp") == reference).select("u", F.col("o").alias("o_ref"), F.col("e").alias("e_ref"))
    nat = cells.groupBy("grp").agg((F.sum("o") / F.sum("e")).alias("rate"))
    base = nat.where(F.col("grp") == reference).select(F.col("rate").alias("base"))
    theta = nat.crossJoin(base).select("grp", (F.col("rate") / F.col("base")).alias("theta"))  # base is one row
    rows = cells.where(F.col("grp") != reference).join(ref, "u").join(theta, "grp")
    expected = F.col("e") * F.col("theta") / (F.col("e") * F.col("theta") + F.col("e_ref"))
    return rows.select("u", "grp", (F.col("o") + F.col("o_ref")).alias("n"), F.col("o").alias("k"), expected.alias("p0"))


def context_percentiles(values: DataFrame, locus: Column) -> DataFrame:
    """Percentile (share not above) of each locus place's context value among all places."""
    return share_not_above(values, "value").where(locus)


def recovery(found: DataFrame, documented: DataFrame) -> DataFrame:
    """Jaccard, precision and recall of found cells (u, year) against documented ones; a share of no cells is NaN, as in SQL."""
    both = found.select("u", "year").distinct().withColumn("f", F.lit(1)).join(documented.select("u", "year").distinct().withColumn("d", F.lit(1)), ["u", "year"], "full_outer")
    f, d, m = F.count("f"), F.count("d"), F.count(F.when(F.col("f").isNotNull() & F.col("d").isNotNull(), 1))
    share = lambda n: F.when(n > 0, m / n).otherwise(F.lit(float("nan")))
    return both.agg(share(f + d - m).alias("jaccard"), share(f).alias("precision"), share(d).alias("recall"))
