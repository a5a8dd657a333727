"""Multiple testing on tables of p-values. Ties are ordered by the id, so results don't depend on partitioning.

Without ``by``, all tests are one family, ranked over range-sorted parts (see ``ranking``), so no task holds them all.
With ``by``, families are ranked side by side, each in one sorted pass over its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.operators.ranking import least_from, running


def _ranked(tests: DataFrame, value: str, id: str, by: list[str]) -> DataFrame:
    """``tests`` with _rank and _m, the number of the family's tests."""
    if by:
        fam = W.partitionBy(*by)
        return tests.withColumns({"_rank": F.row_number().over(fam.orderBy(value, id)), "_m": F.count("*").over(fam)})
    rows = running(tests, [value, id], {"_rank": F.lit(1)})
    return rows.crossJoin(rows.agg(F.count("*").alias("_m")))  # one row


def _per_family(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """``rows`` with aggregates of their family."""
    if by:
        return rows.withColumns({k: v.over(W.partitionBy(*by)) for k, v in values.items()})
    return rows.crossJoin(rows.agg(*[v.alias(k) for k, v in values.items()]))  # one row


def bh(tests: DataFrame, q: float, *, p: str = "p", id: str = "id", by: tuple[str, ...] = (), dependent: bool = False, weight: str | None = None) -> DataFrame:
    """``tests`` with ``rejected``: (weighted) Benjamini-Hochberg, Benjamini-Yekutieli if ``dependent``.

    Weights are scaled to mean 1 in each family and divide the p-values.
    """
    fam = list(by)
    rows = tests.withColumn("_p", F.col(p))
    if weight:
        rows = _per_family(rows, fam, _w=F.avg(weight)).withColumn("_p", F.col(p) / (F.col(weight) / F.col("_w"))).drop("_w")
    rows = _ranked(rows, "_p", id, fam)
    rows = _per_family(rows, fam, _c=F.sum(1 / F.col("_rank"))) if dependent else rows.withColumn("_c", F.lit(1.0))
    level = F.lit(q) * F.col("_rank") / (F.col("_m") * F.col("_c"))
    rows = _per_family(rows, fam, _last=F.max(F.when(F.col("_p") <= level, F.col("_rank"))))
    return rows.withColumn("rejected", F.coalesce(F.col("_rank") <= F.col("_last"), F.lit(False))).drop("_p", "_m", "_rank", "_c", "_last")


def adjusted(tests: DataFrame, *, p: str = "p", id: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """``tests`` with ``q_value``: the least level at which Benjamini-Hochberg rejects each."""
    rows = _ranked(tests, p, id, list(by))
    own = F.col(p) * F.col("_m") / F.col("_rank")
    if by:
        rows = rows.withColumn("_q", F.min(own).over(W.partitionBy(*by).orderBy(p, id).rowsBetween(0, W.unboundedFollowing)))
    else:
        rows = least_from(rows, [p, id], "_q", own)
    return rows.withColumn("q_value", F.least(F.lit(1.0), F.col("_q"))).drop("_m", "_rank", "_q")


def simes(tests: DataFrame, *, by: tuple[str, ...], p: str = "p", id: str = "id") -> DataFrame:
    """Simes p-value of each family: the least p m / rank."""
    fam = W.partitionBy(*by)
    rows = tests.withColumn("_v", F.col(p) * F.count("*").over(fam) / F.row_number().over(fam.orderBy(p, id)))
    return rows.groupBy(*by).agg(F.min("_v").alias("p"), F.count("*").alias("tests"))


def bogomolov(tests: DataFrame, q: float, *, family: str, p: str = "p", id: str = "id") -> DataFrame:
    """Families chosen by BH on their Simes p-values; in each, BH at q times the share of families chosen."""
    chosen = bh(simes(tests, by=(family,), p=p, id=id), q, id=family)
    chosen = _per_family(chosen, [], _share=F.avg(F.col("rejected").cast("int")))
    chosen = chosen.select(family, F.col("rejected").alias("family_selected"), (F.lit(q) * F.col("_share")).alias("_q"))
    rows = tests.join(chosen, family)
    fam = W.partitionBy(family)
    rows = rows.withColumn("_rank", F.row_number().over(fam.orderBy(p, id))).withColumn("_m", F.count("*").over(fam))
    last = F.max(F.when(F.col(p) <= F.col("_q") * F.col("_rank") / F.col("_m"), F.col("_rank"))).over(fam)
    return rows.withColumn("rejected", F.coalesce(F.col("family_selected") & (F.col("_rank") <= last), F.lit(False))).drop("_rank", "_m", "_q")


def tree_bh(leaves: DataFrame, levels: list[str], q: float, *, p: str = "p", id: str = "id") -> DataFrame:
    """``leaves`` with ``rejected``: hierarchical BH down ``levels`` (coarse first), a node tested only if its parent was chosen.

    A node's p-value is the Simes value of its leaves; among a chosen parent's children BH runs at q times the
    shares of children chosen on the way down.
    """
    rows = leaves.withColumn("_level", F.lit(q))
    parents: list[str] = []
    for level in levels:
        nodes = simes(leaves, by=(*parents, level), p=p, id=id).select(*parents, level, F.col("p").alias("_np"))
        nodes = nodes.join(rows.select(*parents, "_level").distinct(), parents) if parents else nodes.withColumn("_level", F.lit(q))
        ranked = _ranked(nodes, "_np", level, parents)
        kept = _per_family(ranked, parents, _last=F.max(F.when(F.col("_np") <= F.col("_level") * F.col("_rank") / F.col("_m"), F.col("_rank")))).where("_rank <= _last")
        kept = kept.select(*parents, level, (F.col("_level") * F.col("_last") / F.col("_m")).alias("_level"))
        parents = [*parents, level]
        rows = rows.drop("_level").join(kept, parents)
    rows = _ranked(rows, p, id, parents)
    rows = _per_family(rows, parents, _last=F.max(F.when(F.col(p) <= F.col("_level") * F.col("_rank") / F.col("_m"), F.col("_rank"))))
    chosen = rows.where("_rank <= _last").select(id, F.lit(True).alias("rejected"))
    return leaves.join(chosen, id, "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))


def lond(tests: DataFrame, q: float, *, order: str, p: str = "p", by: str) -> DataFrame:
    """Online testing in ``order`` within each stream ``by``: level q g_i (rejections so far + 1), g_i in proportion to 1 / (i ln(i + 1)**2).

    A stream's levels depend on its own past alone, so it is one fold over its rows, streams side by side.
    """
    scale = 1 / sum(1 / (i * math.log(i + 1) ** 2) for i in range(1, 100_001))

    def fold(frame):
        frame = frame.sort_values(order, kind="stable")
        found, levels, hits = 0, [], []
        for i, v in enumerate(frame[p].tolist(), 1):
            levels.append(q * scale / (i * math.log(i + 1) ** 2) * (found + 1))
            hits.append(v <= levels[-1])
            found += hits[-1]
        return frame.assign(level=levels, rejected=hits)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tests.schema)
    return tests.groupBy(by).applyInPandas(fold, schema + ", level double, rejected boolean")


def optimal_weights(xi: Column, alpha: float, c: float) -> Column:
    """Roeder-Wasserman weight of a test with effect xi, for the constant c that makes the mean weight 1, needs a normal
    tail; see ``weight_constant``."""
    from cellweave.functions.tails import normal_two_sided

    return F.when(xi > 0, normal_two_sided(xi / 2 + F.lit(c) / xi) / 2 / F.lit(alpha)).otherwise(F.lit(0.0))


def halves(rows: DataFrame, *, unit: str, within: str) -> DataFrame:
    """``rows`` with ``half`` 0 or 1: units (whole numbers) of each ``within`` in a scattered order, alternately."""
    from cellweave.operators.expectation import scattered

    units = rows.select(unit, within).distinct()
    w = W.partitionBy(within).orderBy(scattered(unit), unit)
    side = units.select(unit, within, (F.row_number().over(w) % 2).alias("half"))
    return rows.join(side, [unit, within])


def replicates(effect_full: Column, effect: Column, p: Column, *, alpha: float = 0.05) -> Column:
    """Same sign, at least half the size, p below alpha."""
    return (F.signum(effect_full) == F.signum(effect)) & (F.abs(effect) >= F.abs(effect_full) / 2) & (p < alpha)


def ledger_family(pending: DataFrame, results: DataFrame, *, id: str = "id") -> DataFrame:
    """Registered tests with their first result; a test without one counts as p = 1."""
    w = W.partitionBy(id).orderBy("at")
    first = results.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(id, "p")
    return pending.join(first, id, "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
