"""Structure between fields: which relations are direct, and which patterns are there in both halves of the data."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.operators.relations import poisson_factors
from cellweave.sources.scratch import staged

#: Penalties from strong to weak, parts that places are dealt to, subsamples of half the parts, and the instability borne.
PENALTIES, PARTS, SUBSAMPLES, BORNE = (0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05), 40, 20, 0.05
#: Patterns can be matched in every order up to so many.
MOST_PATTERNS = 8


def _moments(series: DataFrame, names: list[str], parts: int) -> dict[int, np.ndarray]:
    """For each part of the places the sums of products of the fields and one; cells that lack a field are left out."""
    wide = series.groupBy("u", "year").pivot("field", names).agg(F.first("x")).dropna()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.column_stack([np.ones(len(f)), f[names].to_numpy(float)])
            for part in np.unique(f["part"]):
                own = x[f["part"] == part]
                yield pd.DataFrame({"part": [part], "m": [(own.T @ own).ravel()]})

    rows = wide.withColumn("part", F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int")).mapInPandas(work, "part int, m array<double>")
    size = (len(names) + 1) ** 2
    sums = rows.select("part", F.posexplode("m").alias("i", "x")).groupBy("part", "i").agg(F.sum("x").alias("x")).collect()  # fields squared, for each part
    out = {p: np.zeros(size) for p in range(parts)}
    for r in sums:
        out[r.part][r.i] = r.x
    return {p: m.reshape(len(names) + 1, -1) for p, m in out.items()}


def _residual(moments: np.ndarray, factors: int) -> np.ndarray:
    """Correlations, less what the leading common factors carry, as correlations again."""
    n = max(moments[0, 0], 1.0)
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = cov / np.outer(sd, sd)
    if factors:
        value, vector = np.linalg.eigh(corr)
        lead = vector[:, -factors:] * np.sqrt(np.maximum(value[-factors:] - 1, 0))
        corr = corr - lead @ lead.T
        sd = np.sqrt(np.maximum(np.diag(corr), 1e-3))
        corr = corr / np.outer(sd, sd)
    np.fill_diagonal(corr, 1.0)
    return corr


def lasso(corr: np.ndarray, j: int, penalty: float, start: np.ndarray) -> np.ndarray:
    """Field j on all others by coordinate descent: coefficients, 0 for itself. ``start``: those of a stronger penalty."""
    b = start.copy()
    others = np.flatnonzero(np.arange(len(corr)) != j)
    for _ in range(500):
        most = 0.0
        for i in others:
            pull = corr[i, j] - corr[i] @ b + b[i]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0)
            most, b[i] = max(most, abs(new - b[i])), new
        if most < 1e-7:
            break
    return b


def direct_relations(series: DataFrame, *, factors: int = 0, penalties: tuple[float, ...] = PENALTIES, parts: int = PARTS, subsamples: int = SUBSAMPLES, borne: float = BORNE, seed: int = 0) -> DataFrame:
    """(a, b, rho, frequency, partial, direct, penalty) for each pair of fields of ``series`` (field, u, year, x).

    Every field is regressed on all others with a penalty on the coefficients' sizes; a relation is there where both of its
    fields keep the other one. This is done on ``subsamples`` halves of the places for each of ``penalties``: relations that
    come and go are unstable, and the least penalty before the mean instability 2 f (1 - f) exceeds ``borne`` is used.
    frequency: in how many subsamples the relation is there; direct: in more than half of them and in all data; partial:
    its sign and size there; rho: the plain correlation. ``factors``: common factors that are taken out of the
    correlations first, so that what they carry isn't direct. Places are summed in Spark into ``parts`` tables of fields
    squared; each field and subsample is a row of its own.
    """
    spark = series.sparkSession
    names = sorted(r[0] for r in series.select("field").distinct().collect())  # the fields
    if len(names) < 2:
        return spark.createDataFrame([], "a string, b string, rho double, frequency double, partial double, direct boolean, penalty double")
    moments = _moments(series, names, parts)
    rnd = np.random.default_rng(seed)
    chosen = [list(range(parts))] + [sorted(rnd.permutation(parts)[: parts // 2].tolist()) for _ in range(subsamples)]
    tables = [_residual(sum(moments[p] for p in c), factors) for c in chosen]
    plain = _residual(sum(moments.values()), 0)
    falling = sorted(penalties, reverse=True)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s, j in zip(f["s"], f["j"]):
                b = np.zeros(len(names))
                for k in falling:
                    b = lasso(tables[s], j, k, b)
                    kept = np.flatnonzero(b)
                    if len(kept):
                        yield pd.DataFrame({"s": s, "penalty": k, "lo": np.minimum(kept, j), "hi": np.maximum(kept, j), "b": b[kept]})

    jobs = spark.createDataFrame([(s, j) for s in range(len(tables)) for j in range(len(names))], "s int, j int").repartition(min(64, len(tables) * len(names)))
    kept = jobs.mapInPandas(work, "s int, penalty double, lo int, hi int, b double").groupBy("s", "penalty", "lo", "hi").agg(F.count("*").alias("n"), F.min("b").alias("_min"), F.max("b").alias("_max"))
    both = staged(kept.where("n = 2").withColumn("partial", F.when(F.col("_min") * F.col("_max") > 0, F.signum("_max") * F.sqrt(F.col("_min") * F.col("_max"))).otherwise(0.0)), "edges")
    pairs = len(names) * (len(names) - 1) / 2
    freq = both.where("s > 0").groupBy("penalty", "lo", "hi").agg((F.count("*") / subsamples).alias("f"))
    unstable = {r.penalty: r.d for r in freq.groupBy("penalty").agg((F.sum(2 * F.col("f") * (1 - F.col("f"))) / pairs).alias("d")).collect()}  # a row a penalty
    use = falling[0]
    for k in falling:
        if unstable.get(k, 0.0) > borne:
            break
        use = k
    every = spark.createDataFrame([(i, j, names[i], names[j], float(plain[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))], "lo int, hi int, a string, b string, rho double")  # pairs of fields
    rows = every.join(freq.where(F.col("penalty") == use).drop("penalty"), ["lo", "hi"], "left").join(both.where((F.col("s") == 0) & (F.col("penalty") == use)).select("lo", "hi", "partial"), ["lo", "hi"], "left")
    f = F.coalesce("f", F.lit(0.0))
    return rows.select("a", "b", "rho", f.alias("frequency"), F.coalesce("partial", F.lit(0.0)).alias("partial"), ((f > 0.5) & F.col("partial").isNotNull()).alias("direct"), F.lit(use).alias("penalty"))


def congruence(one: DataFrame, other: DataFrame, on: str, value: str) -> np.ndarray:
    """Cosines between the components (k from 1) of two tables (on, k, value), rows of the first by those of the second."""
    norm = lambda t: {r.k: r.s for r in t.where("k > 0").groupBy("k").agg(F.sqrt(F.sum(F.col(value) ** 2)).alias("s")).collect()}
    a, b = norm(one), norm(other)
    cross = one.where("k > 0").select(on, F.col("k").alias("i"), F.col(value).alias("_x")).join(other.where("k > 0").select(on, F.col("k").alias("j"), F.col(value).alias("_y")), on)
    out = np.zeros((len(a), len(b)))
    for r in cross.groupBy("i", "j").agg(F.sum(F.col("_x") * F.col("_y")).alias("s")).collect():  # components squared
        out[r.i - 1, r.j - 1] = r.s / max(a[r.i] * b[r.j], 1e-300)
    return out


def matched(similarity: np.ndarray) -> np.ndarray:
    """For each row its similarity in the one-to-one matching of rows and columns whose sum is largest."""
    n = len(similarity)
    if n > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns can't be matched in every order")
    best = max(permutations(range(n)), key=lambda p: sum(similarity[i, j] for i, j in enumerate(p)))
    return np.array([similarity[i, j] for i, j in enumerate(best)])


def pattern_stability(cells: DataFrame, rank: int, half: Column, *, mode: str = "places", **fit) -> DataFrame:
    """(k, stability, first, second): how far each pattern of ``poisson_factors`` on all cells is there in both halves.

    cells: u, year, y, mu; half: whether a cell is of the first half. With halves of the years, patterns are compared by
    their places (``mode`` "places"), with halves of the places by their years ("years"): cosines, matched one to one so
    that their sum is largest. stability is the lesser of both halves'.
    """
    on, value, which = ("u", "a", 0) if mode == "places" else ("year", "b", 1)
    whole, one, two = (poisson_factors(rows, rank, **fit)[which] for rows in (cells, cells.where(half), cells.where(~half)))
    whole = staged(whole, "patterns")
    first, second = (matched(congruence(whole, part, on, value)) for part in (one, two))
    rows = [(k + 1, float(min(a, b)), float(a), float(b)) for k, (a, b) in enumerate(zip(first, second))]
    return cells.sparkSession.createDataFrame(rows, "k int, stability double, first double, second double")
