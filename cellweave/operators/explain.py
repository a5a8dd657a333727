"""Reading a departure: shapes, attribution, facilities, recoding, exchange with its pool, fixed tests on later years."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def tail_z(observed: Column, mean: Column, variance: Column) -> Column:
    """Normal score of a gamma tail of this mean and variance, by the cube root: no table or series."""
    v = variance / (mean * mean)
    return (F.pow(observed / mean, F.lit(1 / 3)) - (1 - v / 9)) / F.sqrt(v / 9)


def scaled_residual(kappa: Column | float = 1.0) -> Column:
    return (F.col("y") - F.col("mu")) / F.sqrt(F.col("mu") + F.col("mu") ** 2 * kappa / F.col("phi"))


def empirical_null(scores: DataFrame, *, width: float = 0.5) -> DataFrame:
    """``scores`` (z) with z0 and lfdr: two groups, the null's centre and spread from the middle half, its share from the middle.

    Densities are counts in bins of ``width`` spreads; the null's is a normal's. lfdr is cut at 1.
    """
    q = lambda p: F.percentile("z", F.lit(p))
    null = scores.agg(q(0.5).alias("_c"), ((q(0.75) - q(0.25)) / 1.349).alias("_s"), F.count("*").alias("_n"))
    rows = scores.crossJoin(null).withColumn("z0", (F.col("z") - F.col("_c")) / F.col("_s"))  # one row
    middle = rows.agg(F.least(F.lit(1.0), F.avg((F.abs("z0") <= 1).cast("int")) / 0.6826894921370859).alias("pi0"))
    rows = rows.withColumn("_bin", F.floor(F.col("z0") / width))
    bins = rows.groupBy("_bin").agg((F.count("*") / F.first("_n") / width).alias("_f"))
    rows = rows.join(bins, "_bin").crossJoin(middle)  # one row
    f0 = F.exp(-F.col("z0") ** 2 / 2) / 2.5066282746310002
    return rows.withColumn("lfdr", F.least(F.lit(1.0), F.col("pi0") * f0 / F.col("_f"))).drop("_c", "_s", "_n", "_bin", "_f")


def contrasts(series: DataFrame) -> DataFrame:
    """Per place the largest spike (a year against the others), step (years from one on against those before), and the level and slope. series: u, year, x."""
    every = W.partitionBy("u")
    after, before = every.orderBy("year").rowsBetween(0, W.unboundedFollowing), every.orderBy("year").rowsBetween(W.unboundedPreceding, -1)
    n, total = F.count("*").over(every), F.sum("x").over(every)
    rows = series.withColumns({"spike": F.col("x") - (total - F.col("x")) / (n - 1), "step": F.avg("x").over(after) - F.avg("x").over(before)})
    return rows.groupBy("u").agg(F.max("spike").alias("spike"), F.max_by("year", F.struct("spike", -F.col("year"))).alias("spike_year"), F.max("step").alias("step"), F.max_by("year", F.struct("step", -F.col("year"))).alias("since"), F.avg("x").alias("level"), F.regr_slope("x", "year").alias("slope"))


def shapes(series: DataFrame) -> DataFrame:
    """Per place the squared error left by a level, one spike, one step and a line, and the shape of least n ln(error / n) + k ln n.

    series: u, year, x. A spike takes its year out; a step has a mean on either side. Errors are at least 1e-12.
    """
    every = W.partitionBy("u")
    b, a = every.orderBy("year").rowsBetween(W.unboundedPreceding, -1), every.orderBy("year").rowsBetween(0, W.unboundedFollowing)
    n, s, ss = F.count("*").over(every), F.sum("x").over(every), F.sum(F.col("x") ** 2).over(every)
    left = lambda w: F.coalesce(F.sum(F.col("x") ** 2).over(w) - F.sum("x").over(w) ** 2 / F.count("*").over(w), F.lit(0.0))
    rows = series.withColumns({"_one": ss - F.col("x") ** 2 - (s - F.col("x")) ** 2 / (n - 1), "_two": left(b) + left(a)})
    per = rows.groupBy("u").agg(F.count("*").alias("n"), F.var_pop("x").alias("_v"), F.min("_one").alias("spike"), F.min("_two").alias("step"), (F.regr_syy("x", "year") - F.regr_sxy("x", "year") ** 2 / F.regr_sxx("x", "year")).alias("line"))
    per = per.withColumn("level", F.col("_v") * F.col("n"))
    score = lambda c, k: F.col("n") * F.log(F.greatest(F.col(c), F.lit(1e-12)) / F.col("n")) + k * F.log("n")
    best = F.least(*[F.struct(score(c, k).alias("s"), F.lit(c).alias("c")) for c, k in (("level", 1), ("spike", 3), ("step", 3), ("line", 2))])
    return per.select("u", "level", "spike", "step", "line", best["c"].alias("shape"))


def excess_slope(cells: DataFrame) -> DataFrame:
    """Yearly slope of y - mu of each place."""
    return cells.groupBy("u").agg(F.regr_slope(F.col("y") - F.col("mu"), F.col("year")).alias("slope"))


def weighted_sums(cells: DataFrame, weight: Column, by: list[str]) -> DataFrame:
    """Weighted sums of counts and expectations over cells, and the sum's variance: independent cells, mu + mu**2 / phi each."""
    var = F.col("mu") + F.col("mu") ** 2 / F.col("phi")
    return cells.groupBy(*by).agg(F.sum(weight * F.col("y")).alias("y"), F.sum(weight * F.col("mu")).alias("mu"), F.sum(weight * weight * var).alias("variance"))


def trimmed_background(cells: DataFrame, *, bound: float = 2.0) -> DataFrame:
    """``cells`` with background (within ``bound`` scaled residuals) and each place's ratio over its background cells alone."""
    rows = cells.withColumn("background", F.abs(scaled_residual()) <= bound)
    own = F.col("background").cast("int")
    w = W.partitionBy("u")
    return rows.withColumn("ratio", (F.sum(own * F.col("y")).over(w) + 0.5) / (F.sum(own * F.col("mu")).over(w) + 0.5))


def spatial_clusters(cells: DataFrame, neighbourhoods: DataFrame) -> DataFrame:
    """Each centre's best set of places over the whole period: a prefix of its neighbourhood by y / mu. neighbourhoods: centre, u."""
    from cellweave.operators.departures import best_prefixes

    per = cells.groupBy("u").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"))
    return best_prefixes(neighbourhoods.join(per, "u"), within=("centre",))


def exchange(cells: DataFrame) -> DataFrame:
    """Per field and place the correlation over years of its log ratio with that of the rest of its pool. cells: field, u, year, y, mu."""
    w = W.partitionBy("u", "year")
    rest = {"_y": F.sum("y").over(w) - F.col("y"), "_m": F.sum("mu").over(w) - F.col("mu")}
    rows = cells.withColumns(rest).where("_m > 0")
    ratio = lambda y, m: F.log((F.col(y) + 0.5) / (F.col(m) + 0.5))
    return rows.withColumns({"_a": ratio("y", "mu"), "_b": ratio("_y", "_m")}).groupBy("field", "u").agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("years"))


def recoded_profile(profiles: DataFrame, moved: DataFrame, *, prior: float = 0.5) -> DataFrame:
    """log10 likelihood ratio of each field's moved events by group: its own profile against the other fields'.

    profiles: field, g, n of the base period. moved: field, g, y. Profiles are shares with ``prior`` added to every group.
    """
    f, g, every = W.partitionBy("field"), W.partitionBy("g"), profiles.agg(F.sum("n").alias("_all"), F.count_distinct("g").alias("_k"))
    rows = profiles.withColumns({"_f": F.sum("n").over(f), "_g": F.sum("n").over(g)}).crossJoin(every)  # one row
    own = (F.col("n") + prior) / (F.col("_f") + prior * F.col("_k"))
    other = (F.col("_g") - F.col("n") + prior) / (F.col("_all") - F.col("_f") + prior * F.col("_k"))
    score = rows.select("field", "g", (F.log(own / other) / 2.302585092994046).alias("_s"))
    return moved.join(score, ["field", "g"]).groupBy("field").agg(F.sum(F.col("y") * F.col("_s")).alias("log10_ratio"))


def facility_read(cells: DataFrame, window: Column) -> DataFrame:
    """Per place the facility with the largest share of the change from base to window, years made alike. cells: u, facility, year, y.

    The share is null where no facility has risen.
    """
    years = cells.select("year").distinct().agg(F.sum(window.cast("int")).alias("_w"), F.sum((~window).cast("int")).alias("_b"))
    per = cells.groupBy("u", "facility").agg(F.sum(F.when(window, F.col("y")).otherwise(0)).alias("_in"), F.sum(F.when(window, 0).otherwise(F.col("y"))).alias("_out"))
    per = per.crossJoin(years).withColumn("change", F.col("_in") - F.col("_out") * F.col("_w") / F.col("_b"))  # one row
    best = F.max(F.struct("change", -F.col("facility"))).alias("_top")
    out = per.groupBy("u").agg(best, F.sum("change").alias("change"), F.sum(F.greatest("change", F.lit(0.0))).alias("_rise"))
    return out.select("u", (-F.col("_top.col2")).alias("facility"), F.col("_top.change").alias("own"), "change", F.when(F.col("_rise") > 0, F.col("_top.change") / F.col("_rise")).alias("share"))


def institution_triage(cells: DataFrame, window: Column, *, ratio: float = 1.5) -> DataFrame:
    """Whether a facility's rise of one field is its own (specific) or that of all it does (volume). cells: facility, field, year, y."""
    per = cells.groupBy("facility", "field").agg(F.sum(F.when(window, F.col("y")).otherwise(0)).alias("i"), F.sum(F.when(window, 0).otherwise(F.col("y"))).alias("o"))
    w = W.partitionBy("facility")
    own = (F.col("i") + 0.5) / (F.col("o") + 0.5)
    all = (F.sum("i").over(w) + 0.5) / (F.sum("o").over(w) + 0.5)
    rows = per.withColumns({"own": own, "volume": all})
    kind = F.when(F.col("own") < ratio * F.least(F.lit(1.0), F.col("volume")), "none").when(F.col("own") >= ratio * F.col("volume"), "specific").otherwise("volume")
    return rows.withColumn("class", kind)


def share_triage(cells: DataFrame, window: Column, *, least: int = 30) -> DataFrame:
    """Rivals of a moved share: few events, a denominator that moved instead, or a signal. cells: u, year, k, n."""
    s = lambda c, i: F.sum(F.when(window if i else ~window, F.col(c)).otherwise(0))
    per = cells.groupBy("u").agg(s("k", 1).alias("k1"), s("k", 0).alias("k0"), s("n", 1).alias("n1"), s("n", 0).alias("n0"))
    years = cells.select("year").distinct().agg(F.sum(window.cast("int")).alias("_w"), F.sum((~window).cast("int")).alias("_b"))
    per = per.crossJoin(years)  # one row
    share = (F.col("k1") + 0.5) / (F.col("n1") + 1) / ((F.col("k0") + 0.5) / (F.col("n0") + 1))
    total = F.col("n1") / F.col("_w") / (F.col("n0") / F.col("_b"))
    kind = F.when(F.col("k1") < least, "noise").when((total >= 1.5) | (total <= 1 / 1.5), "denominator").when((share >= 1.25) | (share <= 0.8), "signal").otherwise("noise")
    return per.select("u", share.alias("ratio"), total.alias("total"), kind.alias("class"))


def log_ratio_spread(cells: DataFrame, by: str) -> DataFrame:
    """Weighted standard deviation of log((y + 1/2) / (mu + 1/2)) over groups, weights mu."""
    r, w = F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)), F.col("mu")
    return cells.groupBy(by).agg(F.sqrt(F.sum(w * r * r) / F.sum(w) - (F.sum(w * r) / F.sum(w)) ** 2).alias("spread"), F.count("*").alias("groups"))


def tally(events: DataFrame, lead: Column, inside: Column) -> DataFrame:
    """Events of each facility: of the lead inside and outside its place and years, and all."""
    one = lambda c: F.count(F.when(c, 1))
    return events.groupBy("facility").agg(one(lead & inside).alias("lead_inside"), one(lead & ~inside).alias("lead_outside"), one(inside).alias("inside"), F.count("*").alias("all"))


def fixed_test(cells: DataFrame, locus: Column) -> DataFrame:
    """One locus on years that nothing was chosen on: counts, expectation and z of the sum. cells: u, year, y, mu, phi."""
    rows = weighted_sums(cells.where(locus), F.lit(1.0), [])
    return rows.withColumns({"ratio": (F.col("y") + 0.5) / (F.col("mu") + 0.5), "z": tail_z(F.col("y"), F.col("mu"), F.col("variance"))})


def conserved_level(cells: DataFrame, window: Column) -> DataFrame:
    """A field's change beside that of the pool that it exchanges codes with. cells: pool, field, year, y."""
    s = lambda i, w: F.sum(F.when(window if i else ~window, F.col("y")).otherwise(0))
    per = cells.groupBy("pool", "field").agg(s(1, 0).alias("i"), s(0, 0).alias("o"))
    w = W.partitionBy("pool")
    ratio = lambda i, o: (i + 0.5) / (o + 0.5)
    own, pool = ratio(F.col("i"), F.col("o")), ratio(F.sum("i").over(w), F.sum("o").over(w))
    return per.select("pool", "field", own.alias("own"), pool.alias("conserved"), (F.log(own) / F.log(pool)).alias("_x"), F.when(F.abs(F.log(pool)) >= F.abs(F.log(own)) / 2, "kept").otherwise("moved within").alias("reading")).drop("_x")


def recording_audit(records: DataFrame, window: Column) -> DataFrame:
    """Change of the share of records without a cell beside the change of counted events, by place; graded. records: u, year, reason."""
    c = lambda cond: F.count(F.when(cond, 1))
    bad = F.col("reason").isNotNull()
    per = records.groupBy("u").agg(c(bad & window).alias("b1"), c(~bad & window).alias("g1"), c(bad & ~window).alias("b0"), c(~bad & ~window).alias("g0"))
    left_out = (F.col("b1") + 0.5) / (F.col("b1") + F.col("g1") + 1) / ((F.col("b0") + 0.5) / (F.col("b0") + F.col("g0") + 1))
    grade = F.when((left_out >= 1.5) | (left_out <= 1 / 1.5), "strong").when((left_out >= 1.2) | (left_out <= 1 / 1.2), "weak").otherwise("none")
    return per.select("u", left_out.alias("left_out"), ((F.col("g1") + 0.5) / (F.col("g0") + 0.5)).alias("counted"), grade.alias("grade"))


def same_finding(found: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of findings (id, u, first, last, direction) of one place, direction and overlapping years, with the years shared over those of both."""
    o = others.select(F.col("id").alias("other"), "u", "direction", F.col("first").alias("f2"), F.col("last").alias("l2"))
    both = found.join(o, ["u", "direction"]).where("first <= l2 and f2 <= last and id <> other")
    shared, whole = F.least("last", "l2") - F.greatest("first", "f2") + 1, F.greatest("last", "l2") - F.least("first", "f2") + 1
    return both.select("id", "other", (shared / whole).alias("overlap"))


def confirmed(cells: DataFrame, leads: DataFrame, later: Column) -> DataFrame:
    """Leads (u, effect) on cells they weren't found on: log ratio of the later cells, its z, and whether it has the sign and half the size."""
    per = weighted_sums(cells.where(later), F.lit(1.0), ["u"])
    effect = F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5))
    rows = leads.join(per, "u").withColumns({"later": effect, "z": effect * F.col("mu") / F.sqrt(F.col("variance"))})
    same = (F.signum("later") == F.signum("effect")) & (F.abs("later") >= F.abs("effect") / 2)
    return rows.select("u", "effect", "later", "z", (same & (F.col("z") * F.signum("effect") >= 1.6448536269514722)).alias("confirmed"))


def tier(kinds: DataFrame, *, id: str = "id") -> DataFrame:
    """R0 to R3 from the kinds of evidence that a lead holds: none, another split of the data, another jurisdiction, another source."""
    k = F.collect_set("kind")
    has = lambda *x: reduce(lambda a, b: a | b, [F.array_contains(F.col("kinds"), v) for v in x])
    rows = kinds.groupBy(id).agg(F.array_sort(k).alias("kinds"))
    return rows.withColumn("tier", F.when(has("source"), 3).when(has("space"), 2).when(has("time", "events"), 1).otherwise(0))


def spend_once(claims: DataFrame, *, claim: str = "claim", at: str = "at") -> DataFrame:
    """``claims`` with granted: the reserved years are opened to a claim once, at its first request; later ones are refused."""
    w = W.partitionBy(claim).orderBy(at)
    return claims.withColumn("granted", F.row_number().over(w) == 1)


def conditional_pairs(series: DataFrame, common: str) -> DataFrame:
    """Correlations of fields over places and years, marginal and with a common series held fixed. series: field, u, year, x and ``common``."""
    a = series.select("u", "year", F.col("field").alias("a"), F.col("x").alias("x"), F.col(common).alias("z"))
    b = series.select("u", "year", F.col("field").alias("b"), F.col("x").alias("y"))
    per = a.join(b, ["u", "year"]).where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("rho"), F.corr("x", "z").alias("_xz"), F.corr("y", "z").alias("_yz"), F.count("*").alias("n"))
    return per.select("a", "b", "n", "rho", ((F.col("rho") - F.col("_xz") * F.col("_yz")) / F.sqrt((1 - F.col("_xz") ** 2) * (1 - F.col("_yz") ** 2))).alias("direct"))


def course_pairs(cells: DataFrame) -> DataFrame:
    """Correlations of fields' national courses: log ratios of yearly sums, less their line over the years. cells: field, year, y, mu."""
    per = cells.groupBy("field", "year").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu")).select("field", "year", F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("x"))
    line = per.groupBy("field").agg(F.regr_slope("x", "year").alias("_b"), F.regr_intercept("x", "year").alias("_a"))
    r = per.join(line, "field").select("field", "year", (F.col("x") - F.col("_a") - F.col("_b") * F.col("year")).alias("x"))
    a, b = r.withColumnsRenamed({"field": "a"}), r.withColumnsRenamed({"field": "b", "x": "y"})
    return a.join(b, "year").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("rho"), F.count("*").alias("years"))


def detection_power(cells: DataFrame, thetas: list[float], *, bound: float = 2.0) -> DataFrame:
    """Share of cells whose count, raised by each factor, is a departure of more than ``bound`` scaled residuals, by size of mu."""
    t = F.broadcast(cells.sparkSession.createDataFrame([(float(x),) for x in thetas], "theta double"))  # the given few
    rows = cells.crossJoin(t).withColumn("y", F.round(F.col("y") * F.col("theta"))).withColumn("hit", (scaled_residual() > bound).cast("int"))
    return rows.groupBy("theta", F.floor(F.log10("mu")).cast("int").alias("size")).agg(F.avg("hit").alias("power"), F.count("*").alias("cells"))


def absorbed_share(cells: DataFrame, inside: Column, theta: float) -> DataFrame:
    """How much of a planted effect the expectation takes up when it is fitted anew: its rise inside over the planted events. cells: year, y, n, mu."""
    more = F.when(inside, F.col("y") * (theta - 1)).otherwise(0.0)
    w = W.partitionBy("year")
    rows = cells.withColumn("_more", more).withColumn("_rise", F.col("n") * F.sum("_more").over(w) / F.sum("n").over(w))
    return rows.where(inside).agg((F.sum("_rise") / F.sum("_more")).alias("absorbed"), F.sum("_more").alias("planted"))


def negative_pairs(series: DataFrame, shift: int) -> DataFrame:
    """Correlations between fields whose places were rotated by ``shift`` against each other: controls without a relation.

    series: field, u, year, x. Places are numbered in their order; the numbers wrap round.
    """
    from cellweave.operators.ranking import running

    ids = running(series.select("u").distinct(), ["u"], {"k": F.lit(1)})
    n = ids.agg(F.count("*").alias("_n"))
    ids = ids.crossJoin(n)  # one row
    a = series.join(ids, "u").select(F.col("field").alias("a"), F.pmod(F.col("k") - 1 + shift, F.col("_n")).alias("k"), "year", "x")
    b = series.join(ids, "u").select(F.col("field").alias("b"), (F.col("k") - 1).alias("k"), "year", F.col("x").alias("y"))
    return a.join(b, ["k", "year"]).where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("rho"))


def least_delta(pairs: DataFrame, q: float) -> DataFrame:
    """The least size of correlation that at most a share q of the control pairs exceeds."""
    return pairs.agg(F.percentile(F.abs("rho"), F.lit(1 - q)).alias("delta"), F.count("*").alias("pairs"))
