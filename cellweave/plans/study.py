"""Studies: a declaration is validated, resolved to fields, run question by question, and read as ranked findings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.functions.tails import chi2_upper, nb_upper, normal_two_sided
from cellweave.operators import departures as d, error_control as ec, models, waves
from cellweave.operators.graphs import neighbourhoods
from cellweave.operators.interpret import lead_rank
from cellweave.operators.ranking import running

QUESTIONS = ("excess", "step", "trend")  # those that cells alone answer
#: Places of a scanned neighbourhood, simulated maps of a scan, and the chance of a step before any data.
NEAR, SCAN_REPLICATES, STEP_PRIOR = 8, 200, 0.05


@dataclass
class Study:
    """seeds: prefixes of codes; period: first and last year; where: places or None for all; q: error level."""

    name: str
    seeds: list[str]
    period: tuple[int, int]
    where: list[int] | None = None
    questions: tuple[str, ...] = QUESTIONS
    q: float = 0.1
    ratios: dict[str, str] = field(default_factory=dict)


def load(declaration: dict) -> Study:
    """A study of a declaration; all its problems are reported at once."""
    wrong = []
    for key in ("study", "seeds", "period"):
        if not declaration.get(key):
            wrong.append(f"{key} is missing")
    period = declaration.get("period") or (0, 0)
    if isinstance(period, str):
        period = span(period)
    if len(period) != 2 or period[0] > period[1]:
        wrong.append(f"period {period} isn't a first and a last year")
    for x in declaration.get("questions", QUESTIONS):
        if x not in METHODS:
            wrong.append(f"question {x!r} is unknown")
    if not 0 < declaration.get("q", 0.1) < 1:
        wrong.append("q must lie between 0 and 1")
    if unknown := set(declaration) - {"study", "seeds", "period", "where", "questions", "q", "ratios"}:
        wrong.append(f"unknown entries {sorted(unknown)}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return Study(declaration["study"], list(declaration["seeds"]), tuple(period), declaration.get("where"), tuple(declaration.get("questions", QUESTIONS)), declaration.get("q", 0.1), declaration.get("ratios", {}))


def span(text: str) -> tuple[int, int]:
    """First and last year of "2018", "2018..2020" or "2018-01..2018-06"."""
    ends = [int(x.strip()[:4]) for x in text.split("..")]
    return ends[0], ends[-1]


def scope(study: Study, cells: DataFrame) -> DataFrame:
    """The cells that a study is about."""
    seeds = reduce(lambda a, b: a | b, [F.col("code").startswith(s) for s in study.seeds], F.lit(False))
    rows = cells.where(seeds & F.col("year").between(*study.period))
    return rows.where(F.col("u").isin(study.where)) if study.where else rows


@dataclass
class Inputs:
    """What questions read: cells (u, year, n, y, mu, phi), and for some of them more tables; see the questions.

    edges: a, b both ways. shares: u, year, y, n, share. facilities: facility (a place of its own), year, y, mu.
    groups: u, g, y, mu. months: u, year, month, y, mu. distance: source, u, d. train_last: last year that was learnt from.
    """

    cells: DataFrame
    edges: DataFrame | None = None
    shares: DataFrame | None = None
    facilities: DataFrame | None = None
    groups: DataFrame | None = None
    months: DataFrame | None = None
    distance: DataFrame | None = None
    train_last: int | None = None


def _found(rows: DataFrame, method: str, *, locus: str = "place", u: str = "u", first=None, last=None, effect=None) -> DataFrame:
    """Findings of one method: rows have p, and q_value (p adjusted within the method's own tests)."""
    one = lambda x, t: (F.lit(None) if x is None else x).cast(t)
    return rows.select(F.lit(locus).alias("locus"), F.col(u).cast("int").alias("u"), one(first, "int").alias("first"), one(last, "int").alias("last"), F.lit(method).alias("method"), "p", "q_value", one(effect, "double").alias("effect"))


def _years(found: DataFrame, cells: DataFrame) -> DataFrame:
    """Findings without years of their own are of all years."""
    span = cells.agg(F.min("year").alias("_f"), F.max("year").alias("_l"))
    return found.crossJoin(span).withColumns({"first": F.coalesce("first", "_f"), "last": F.coalesce("last", "_l")}).drop("_f", "_l")  # span is one row


def _passing(tests: DataFrame, q: float, *, id: str = "id", weight: str | None = None) -> DataFrame:
    """The tests whose adjusted p is at most q; a weight (scaled to mean 1) divides p first."""
    if weight:
        mean = tests.agg(F.avg(weight).alias("_mean"))
        tests = tests.crossJoin(mean).withColumn("_p", F.col("p") / (F.col(weight) / F.col("_mean"))).drop("_mean")  # one row
    return ec.adjusted(tests, p="_p" if weight else "p", id=id).where(F.col("q_value") <= q)


def _log_ratio(mu: str) -> Column:
    return F.log((F.col("y") + 0.5) / (F.col(mu) + 0.5))


def _level(x: Inputs, q: float) -> DataFrame:
    """Places above their expectation over all years."""
    per = _all_years(x.cells)
    return _found(_passing(per.withColumn("p", nb_upper("y", d.RATE_RATIO * F.col("mu"), "phi")), q, id="u"), "excess_level", effect=_log_ratio("mu"))


def _all_years(cells: DataFrame) -> DataFrame:
    return cells.groupBy("u").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"), (F.sum("mu") ** 2 / F.sum(F.col("mu") ** 2 / F.col("phi"))).alias("phi"))


def _scanned(x: Inputs, q: float) -> DataFrame:
    """Sets of places near each other that are above expectation together, by scan under simulated maps; a finding for each member.

    Sets are reported one after the other, five at most, each once those before it are explained; its p is already one of a search.
    """
    per = _all_years(x.cells).withColumn("year", F.lit(0))
    near = neighbourhoods(x.edges, NEAR)
    rows = d.space_time(per, near, longest=1, replicates=SCAN_REPLICATES, alpha=q, most=5).where("reported is not null")
    rows = rows.select("p", F.col("p").alias("q_value"), F.explode("places").alias("u")).groupBy("u").agg(F.min("p").alias("p"), F.min("q_value").alias("q_value"))
    return _found(rows.join(per.select("u", "y", "mu"), "u"), "cluster", effect=_log_ratio("mu"))


def _propagation(x: Inputs, q: float) -> DataFrame:
    onset = waves.onsets(d.outbreak(x.cells, q).select("u", "year", "rejected"))
    rows = waves.waves(onset, x.distance, q=q).where("found").withColumn("q_value", F.col("p"))  # tested one after the other
    return _found(rows, "propagation", u="source", effect=F.col("rho"))


def _share(x: Inputs, q: float) -> DataFrame:
    tests = d.share_excess(x.shares, q).withColumn("id", F.concat_ws(":", "u", "year"))
    return _found(_passing(tests, q).where("found"), "share_excess", first=F.col("year"), last=F.col("year"), effect=F.log("ratio"))


def _institution(x: Inputs, q: float) -> DataFrame:
    # twice the log likelihood ratio of a window against none, on two degrees of freedom
    rows = _passing(d.institution_windows(x.facilities).withColumn("p", F.exp(-F.col("g") / 2)), q, id="facility").where("found")
    return _found(rows, "institution_step", locus="facility", u="facility", first=F.col("first"), last=F.col("last"), effect=F.log("ratio"))


def _group(x: Inputs, q: float) -> DataFrame:
    rows = d.group_spread(x.groups).where("df > 0").withColumn("p", chi2_upper("g2", F.col("df").cast("double")))
    return _found(_passing(rows, q, id="u"), "group_disparity", effect=F.log(F.col("g2") / F.col("df")))


def _divergence(x: Inputs, q: float) -> DataFrame:
    rows = d.divergence(d.trends(x.cells), x.edges).withColumn("p", normal_two_sided(F.col("difference") / F.col("sd")))
    return _found(_passing(rows, q, id="u"), "trend_divergence", effect=F.col("difference"))


def _seasonality(x: Inputs, q: float) -> DataFrame:
    return _found(_passing(d.season_departure(d.harmonics(x.months)), q, id="u"), "season_departure", effect=F.col("amplitude"))


def _prospective(x: Inputs, q: float) -> DataFrame:
    rows = models.prospective(x.cells.select("u", "year", "y", "n"), x.train_last).join(x.cells.select("u", "year", "phi"), ["u", "year"])
    rows = rows.withColumns({"p": nb_upper("y", d.RATE_RATIO * F.col("bpa"), "phi"), "id": F.concat_ws(":", "u", "year")})
    return _found(_passing(rows, q, weight="bpa"), "outbreak", first=F.col("year"), last=F.col("year"), effect=_log_ratio("bpa"))


def _excess(x: Inputs, q: float) -> DataFrame:
    tests = d.outbreak(x.cells, q).drop("rejected")
    return _found(_passing(tests, q, weight="mu"), "outbreak", first=F.col("year"), last=F.col("year"), effect=F.log("ratio"))


def _change(x: Inputs, q: float) -> DataFrame:
    return _found(_passing(d.change_point(x.cells, q), q, id="u"), "change_point", first=F.col("since"), last=F.lit(9999))


def _step(x: Inputs, q: float) -> DataFrame:
    """Steps up. p: one over the Bayes factor against no step, which chance exceeds at most that often (Markov's inequality);
    q_value: the mean posterior chance of no step among the places at least as likely to have one."""
    rows = d.steps(x.cells, prior=STEP_PRIOR)
    chance = 1 - F.col("posterior")
    p = F.least(F.lit(1.0), F.greatest(chance, F.lit(1e-16)) / F.greatest(F.col("posterior"), F.lit(1e-300)) * STEP_PRIOR / (1 - STEP_PRIOR))
    rows = running(rows, [F.desc("posterior"), F.asc("u")], {"_null": chance, "_k": F.lit(1)})
    rows = rows.withColumns({"q_value": F.col("_null") / F.col("_k"), "p": p}).where((F.col("q_value") <= q) & (F.col("size") > 0))
    return _found(rows, "step", first=F.col("since"), last=F.lit(9999), effect=F.col("size"))


def _trend(x: Inputs, q: float) -> DataFrame:
    rows = d.trends(x.cells).withColumn("p", normal_two_sided(F.col("beta") / F.col("sd")))
    return _found(_passing(rows, q, id="u"), "trend", effect=F.col("beta"))


#: Each question's methods, and the table that they need beside the cells.
METHODS = {
    "excess": ([_excess], None),
    "step": ([_change, _step], None),
    "trend": ([_trend], None),
    "cluster": ([_level, _scanned], "edges"),
    "propagation": ([_propagation], "distance"),
    "share": ([_share], "shares"),
    "institution": ([_institution], "facilities"),
    "group": ([_group], "groups"),
    "divergence": ([_divergence], "edges"),
    "seasonality": ([_seasonality], "months"),
    "prospective": ([_prospective], "train_last"),
}


def ask(question: str, inputs: Inputs | DataFrame, q: float) -> DataFrame:
    """Findings (locus, u, first, last, p, q_value, effect, methods) of one question; each of its methods runs at q over their number.

    u is a place or, where ``locus`` says so, a facility. q_value is adjusted within a method's tests and for their number.
    """
    x = Inputs(inputs) if isinstance(inputs, DataFrame) else inputs
    methods, need = METHODS[question]
    if need and getattr(x, need) is None:
        raise ValueError(f"question {question!r} needs {need}")
    made = [_years(f(x, q / len(methods)), x.cells).withColumn("q_value", F.least(F.lit(1.0), F.col("q_value") * len(methods))) for f in methods]
    return merged(reduce(DataFrame.unionByName, made)).withColumn("question", F.lit(question))


def merged(found: DataFrame) -> DataFrame:
    """Findings of one locus whose years overlap as one: the union of their years, the least p and q_value, the methods that agree."""
    if "locus" not in found.columns:
        found = found.withColumn("locus", F.lit("place"))
    if "q_value" not in found.columns:
        found = found.withColumn("q_value", F.col("p"))
    w = W.partitionBy("locus", "u").orderBy("first", "last", "method")
    end = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = found.withColumn("_new", F.coalesce((F.col("first") > end).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    best: Column = F.max_by("effect", F.struct(-F.col("p"), "method"))
    return rows.groupBy("locus", "u", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("p").alias("p"), F.min("q_value").alias("q_value"), best.alias("effect"), F.array_sort(F.collect_set("method")).alias("methods")).drop("_run")


def run(study: Study, inputs: Inputs | DataFrame) -> DataFrame:
    """Ranked findings of all the study's questions; q: a finding's q_value times the number of questions, so none is above the study's."""
    k = len(study.questions)
    found = reduce(DataFrame.unionByName, [ask(x, inputs, study.q / k) for x in study.questions])
    found = found.withColumn("q", F.least(F.lit(1.0), F.col("q_value") * k))
    rank = lead_rank(F.col("q"), F.coalesce("effect", F.lit(0.0)), F.size("methods") - 1)
    return found.withColumn("rank", rank)
