"""Courses, predictive mixtures, shapes, random sets and surrogates over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cellweave.operators import courses as co, error_control as ec, institutions as ins, mixtures as mx, multiscale as ms, nulls as nu, shapes as sh, structure as stx, variance as va, waves as wv
from cellweave.operators.expectation import dispersion, scattered
from cellweave.operators.ranking import running
from cellweave.queries.base import REC, expected, governed, people, places, query
from cellweave.queries.more import _first_orders
from cellweave.sources.records import table
from cellweave.sources.scratch import staged

r4 = lambda col, name: F.round(col, 4).alias(name)
#: The last year that predictions know.
KNOWN = 1998


@query()
def place_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and slope of every place around its expectation, with their strengths and uncertainty."""
    c = F.col
    return co.place_courses(expected(spark, sf_dir)).select("u", r4(c("coef")[0], "level"), r4(c("coef")[1], "slope"), r4(c("sd")[0], "level_sd"), r4(c("sd")[1], "slope_sd"), F.round(c("cov")[0][1], 6).alias("covariance"), F.round(F.log10(c("strength")[0]), 2).alias("log_level_strength"), F.round(F.log10(c("strength")[1]), 2).alias("log_slope_strength"))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, month: since year 0, y, mu, phi): monthly counts at each month's rate per customer."""
    rows = governed(spark, sf_dir).groupBy("u", (F.col("year") * 12 + F.col("month") - 1).alias("month")).agg(F.sum("wt").alias("y"))
    rows = rows.join(people(spark, sf_dir), "u")
    w = W.partitionBy("month")
    rows = staged(rows.withColumn("mu", F.col("n") * F.sum("y").over(w) / F.sum("n").over(w)), "monthly")
    return rows.crossJoin(dispersion(rows))  # one row


@query()
def place_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, slope and yearly wave of every place over months."""
    c = F.col
    return co.place_courses(_monthly(spark, sf_dir), at="month", terms=("level", "slope", "season")).select("u", *[r4(c("coef")[i], n) for i, n in enumerate(("level", "slope", "sine", "cosine"))], r4(c("sd")[2], "sine_sd"))


def _foretold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years after KNOWN with their predictive mixtures: regimes of regions, courses of places."""
    cells = expected(spark, sf_dir).join(places(spark, sf_dir).select("u", F.col("region").alias("g")), "u")
    train = staged(cells.where(F.col("year") <= KNOWN), "train")
    per = W.partitionBy("g", "year")
    base = train.withColumn("mu", F.col("n") * F.sum("y").over(per) / F.sum("n").over(per))
    ahead = tuple(y for y in co.grid_of(cells, "year") if y > KNOWN)
    shifts = co.by_period(co.place_courses(base, ahead=ahead), later=True)
    groups = mx.regimes(train, KNOWN, steps=len(ahead))
    return mx.predictive(cells.drop("mu"), groups, shifts, KNOWN, phi=F.col("phi"))


@query()
def prospective_predictive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later years' counts against mixtures of what the known years foretell, with the alarm that each would be."""
    rows = _foretold(spark, sf_dir).withColumn("v", scattered("u", "year"))
    rows = rows.withColumn("s", mx.mixture_score("y", "weight", "mu", "phi", "v")).withColumn("threshold", mx.mixture_quantile(F.lit(0.99), "weight", "mu", "phi"))
    return rows.select("u", "year", "y", r4(F.col("s.mean"), "mean"), r4(F.col("s.upper"), "p"), r4(F.col("s.pit"), "pit"), "threshold", (F.col("y") > F.col("threshold")).alias("alarm"))


@query()
def regime_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each rule foretold the last known years of each region."""
    cells = expected(spark, sf_dir).join(places(spark, sf_dir).select("u", F.col("region").alias("g")), "u")
    return mx.regimes(cells, KNOWN, steps=1).select("g", *[r4(F.col("weight")[i], name) for i, name in enumerate(mx.RULES)])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly quantities of each supplier's nation by part brand: (u: brand and nation, at, y, exposure)."""
    li, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    rows = li.join(s.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    rows = rows.groupBy(F.concat_ws("|", "p_brand", "s_nationkey").alias("u"), F.year("l_shipdate").alias("at")).agg(F.count("*").alias("y"))
    grid = rows.select("u").distinct().crossJoin(rows.select("at").distinct())  # series by years
    return staged(grid.join(rows, ["u", "at"], "left").na.fill(0), "lines")


@query()
def course_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interventions of each brand's yearly sales from a nation, under the noise of its own course."""
    rows = _lines(spark, sf_dir)
    own, at = W.partitionBy("u"), W.partitionBy("at")
    total = rows.agg(F.sum("y").alias("_all"))
    rows = rows.withColumn("mu", F.sum("y").over(own) * F.sum("y").over(at)).crossJoin(total).withColumn("mu", F.col("mu") / F.col("_all"))  # one row
    rows = staged(rows, "attributed")
    spread = rows.agg(F.greatest(F.lit(1.0), F.avg((F.col("y") - F.col("mu")) ** 2 / F.col("mu"))).alias("_k"))
    rows = rows.crossJoin(spread).withColumn("var", F.col("mu") * F.col("_k"))  # one row
    series = co.series(rows, ["y", "mu", "var"], at="at").withColumn("rho", F.lit(0.2))
    return sh.attributed(series).select("u", "shape", F.size("effects").alias("effects"), F.get("effects", F.lit(0))["start"].alias("start"), F.round(F.get("effects", F.lit(0))["z"], 3).alias("z"))


@query()
def change_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abrupt or gradual: each brand's yearly sales from a nation against the nation's."""
    rows = _lines(spark, sf_dir)
    nation = W.partitionBy(F.element_at(F.split("u", r"\|"), 2), "at")
    rows = rows.withColumn("exposure", F.sum("y").over(nation).cast("double"))
    out = sh.slope_tail(sh.shaped(co.series(rows, ["y", "exposure"], at="at")), least=0.0, rising=True, freedom=5)
    return out.select("u", r4(F.col("slope"), "slope"), r4(F.col("slope_se"), "slope_se"), "shape", F.round("gap", 3).alias("gap"), "year", r4(F.col("jump"), "jump"), r4(F.col("p"), "p"))


@query()
def profile_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose lines does each brand look like: returned ones' or the others' profile over ship months."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = li.join(p, "l_partkey").groupBy("p_brand", F.month("l_shipdate").alias("m")).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") != "R").alias("o"), F.count_if(F.col("l_discount") > 0.09).alias("d"))
    rows = rows.groupBy(F.col("p_brand").alias("id")).agg(F.sort_array(F.collect_list(F.struct("m", F.col("d").cast("double").alias("moved"), F.col("r").cast("double").alias("node"), F.col("o").cast("double").alias("rest")))).alias("s"))
    return sh.profile_moved(rows.select("id", *[F.col(f"s.{c}").alias(c) for c in ("moved", "node", "rest")])).select("id", "n", r4(F.col("llr"), "llr"), r4(F.col("p_node"), "p_node"), r4(F.col("p_rest"), "p_rest"), "result")


@query()
def connected_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do suppliers of a stretch of balances sell more in two years than random connected sets of suppliers? The graph links the next two."""
    s = running(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("state"), F.col("s_acctbal").alias("at")), ["at", "u"], {"k": F.lit(1)})
    s = staged(s, "suppliers")
    n = s.agg(F.max("k").alias("_n"))
    s = s.crossJoin(n)  # one row
    near = s.select(F.col("u").alias("a"), F.explode(F.array(*[F.col("k") + F.lit(i) for i in (-2, -1, 1, 2)])).alias("k")).join(s.select(F.col("u").alias("b"), "k"), "k").select("a", "b")
    where = s.select("u", "state", F.floor(F.col("k") * 5 / (F.col("_n") + 1)).cast("int").alias("quintile"))
    members = s.where((F.col("k") >= F.col("_n") * 0.4) & (F.col("k") < F.col("_n") * 0.4 + 8) | (F.col("k") % F.greatest(F.lit(2), (F.col("_n") / 5).cast("int")) == 0)).select("u")
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("u"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("y"))
    sets = nu.random_sets(members, where, near, replicates=499)
    return nu.corroborated_by(nu.usual_years(sold, 1998, 1999), members, sets).select(r4(F.col("x"), "x"), r4(F.col("median"), "median"), r4(F.col("p"), "p"), "replicates")


@query()
def course_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of part types' courses over half-years, national and by region, at lags up to two, under one error level."""
    rows = governed(spark, sf_dir).select(F.element_at(F.split("code", r"\|"), 1).alias("field"), "u", (F.col("year") * 4 + F.floor((F.col("month") - 1) / 3)).cast("int").alias("year"), "wt")
    rows = rows.groupBy("field", "u", "year").agg(F.sum("wt").alias("y"))
    at = W.partitionBy("u", "year")
    total = rows.groupBy("field").agg(F.sum("y").alias("_f")).withColumn("_share", F.col("_f") / F.sum("_f").over(W.partitionBy(F.lit(0)))).drop("_f")  # a row a field
    rows = rows.withColumn("mu", F.sum("y").over(at)).join(F.broadcast(total), "field").withColumn("mu", F.col("mu") * F.col("_share"))
    found = nu.lagged_relations(nu.field_courses(rows, places(spark, sf_dir)))
    found = ec.bh(found.withColumn("id", F.concat_ws(":", "support", "field", "leader", "lag")), 0.05)
    return found.select("support", "field", "leader", "lag", "n", r4(F.col("rho"), "rho"), r4(F.col("p"), "p"), r4(F.col("p_any"), "p_any"), "rejected")


@query(
    """WITH o AS (SELECT l_suppkey AS u, min(l_shipdate)::DATE - DATE '1994-01-01' AS onset FROM lineitem GROUP BY ALL),
rk AS (SELECT u, rank() OVER (ORDER BY onset) + (count(*) OVER (PARTITION BY onset) - 1) / 2.0 AS r FROM o),
s AS (SELECT *, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS k FROM supplier),
d AS (SELECT a.s_suppkey AS source, b.s_suppkey AS u, abs(a.s_acctbal - b.s_acctbal) AS d FROM s a JOIN s b ON b.k BETWEEN a.k - 30 AND a.k + 30),
g AS (SELECT source, d, count(*) AS m, sum(r) AS sr, sum(r * r) AS srr FROM d JOIN rk USING (u) GROUP BY ALL),
n AS (SELECT *, sum(m) OVER (PARTITION BY source ORDER BY d) AS n FROM g), k AS (SELECT *, n - (m - 1) / 2.0 AS k FROM n),
c AS (SELECT source, d, n, sum(sr) OVER w / n AS sr, sum(srr) OVER w / n AS srr, sum(m * k) OVER w / n AS sk, sum(m * k * k) OVER w / n AS skk, sum(sr * k) OVER w / n AS srk FROM k WINDOW w AS (PARTITION BY source ORDER BY d)),
h AS (SELECT source, d, n, CASE WHEN (srr - sr * sr) * (skk - sk * sk) > 1e-9 THEN (srk - sr * sk) / sqrt((srr - sr * sr) * (skk - sk * sk)) ELSE 0 END AS rho FROM c WHERE n >= 10),
z AS (SELECT *, round(ln((1 + least(0.999999, greatest(-0.999999, rho))) / (1 - least(0.999999, greatest(-0.999999, rho)))) / 2 * sqrt(n - 3), 9) AS score FROM h)
SELECT source, round(max(score), 4) AS score, arg_max(n, {'s': score, 'n': n})::INT AS places, round(arg_max(rho, {'s': score, 'n': n}), 4) AS rho FROM z GROUP BY ALL"""
)
def wave_disc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disc around each supplier in which first sales follow the distance in balance most clearly."""
    return wv.wave_scores(*_first_orders(spark, sf_dir)).select("source", r4(F.col("score"), "score"), "places", r4(F.col("rho"), "rho"))


@query()
def variance_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much yearly sales of nations' brands vary beyond Poisson noise: of all, by region of the supplier, by nation."""
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("nation"), F.col("n_regionkey").alias("region"))
    rows = _lines(spark, sf_dir).withColumn("nation", F.element_at(F.split("u", r"\|"), 2)).join(regions, "nation")
    own, at = W.partitionBy("u"), W.partitionBy("at")
    total = rows.agg(F.sum("y").alias("_all"))
    rows = rows.withColumn("mu", F.sum("y").over(own) * F.sum("y").over(at)).crossJoin(total).withColumn("mu", F.col("mu") / F.col("_all"))  # one row
    _, levels = va.place_year_variance(rows.withColumn("phi", F.lit(1e9)), ["region", "nation"], trim=0.0)
    return levels.select("level", "group", F.round("own_estimate", 2).alias("own_estimate"), F.round("log_variance", 2).alias("log_variance"))


@query()
def graph_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of nations' departures over scales of the care-flow graph and windows of years."""
    from cellweave.queries.analysis import _flow

    flow = _flow(spark, sf_dir).where("weight > 0.1")
    return ms.peaks(expected(spark, sf_dir), flow, scales=[0, 1, 2], replicates=20).select("u", "scale", "first", "last", F.round("z", 3).alias("z"), r4(F.col("ratio"), "ratio"), r4(F.col("p"), "p"))


@query()
def online_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly tests of nations as a stream in three batches, each nation's levels kept as state."""
    import tempfile
    import uuid

    from cellweave.queries.analysis import _tests
    from cellweave.streaming import online

    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="cellweave-")
    source, out, state = (f"{top}/cellweave/online-{uuid.uuid4().hex}/{x}" for x in ("in", "out", "state"))
    tests = staged(_tests(spark, sf_dir).select("id", "u", "year", "p"), "tests")
    for part in (F.col("year") < 1997, F.col("year").between(1997, 1999), F.col("year") > 1999):
        tests.where(part).write.mode("append").parquet(source)
        online.drained(online.lond_stream(spark.readStream.schema(tests.schema).parquet(source), 0.5, by="u", order="year"), out, state)
    return spark.read.parquet(out).select("id", "u", r4(F.col("p"), "p"), "number", F.round("level", 8).alias("level"), "rejected")


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by residence, facility and year: of one part type's first brand, of the type, of all; facility 7 names none."""
    rows = governed(spark, sf_dir).select("u", F.when(F.col("facility") != 7, F.col("facility")).alias("facility"), "year", "code")
    return staged(rows.groupBy("u", "facility", "year").agg(F.count_if(F.col("code") == "ECONOMY|Brand#1").alias("lead"), F.count_if(F.col("code").startswith("ECONOMY|")).alias("block"), F.count("*").alias("total")), "recorded")


@query(
    f"""WITH {REC}, c AS (SELECT u, CASE WHEN facility <> 7 THEN facility END AS facility, year, count(*) FILTER (code = 'ECONOMY|Brand#1') AS lead, count(*) FILTER (code LIKE 'ECONOMY|%') AS block, count(*) AS total FROM cells GROUP BY ALL),
n AS (SELECT count(DISTINCT year) FILTER (year >= 1999) AS nw, count(DISTINCT year) FILTER (year < 1999) AS nb FROM c),
p AS (SELECT u, facility, coalesce(sum(lead) FILTER (year >= 1999), 0) AS lw, coalesce(sum(lead) FILTER (year < 1999), 0) AS lb, coalesce(sum(block) FILTER (year >= 1999), 0) AS bw, coalesce(sum(block) FILTER (year < 1999), 0) AS bb, coalesce(sum(total) FILTER (year >= 1999), 0) AS tw, coalesce(sum(total) FILTER (year < 1999), 0) AS tb FROM c GROUP BY ALL),
d AS (SELECT p.*, nw, nb, greatest(lw / nw - lb / nb, 0) AS d, CASE WHEN facility IS NOT NULL THEN greatest(lw / nw - lb / nb, 0) ELSE 0 END AS pos FROM p, n),
r AS (SELECT *, sum(d) OVER o AS gain, sum(bb) OVER o AS ref, row_number() OVER w AS rnk, sum(pos) OVER (PARTITION BY u ORDER BY pos DESC, facility NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM d WINDOW o AS (PARTITION BY u), w AS (PARTITION BY u ORDER BY pos DESC, facility NULLS LAST)),
k AS (SELECT *, min(CASE WHEN rnk <= 3 AND gain > 0 AND upto >= 0.7 * gain THEN rnk END) OVER (PARTITION BY u) AS k FROM r),
f AS (SELECT facility, sum(lw) AS alw, sum(lb) AS alb, sum(bw) AS abw, sum(bb) AS abb FROM p WHERE facility IS NOT NULL GROUP BY ALL),
t AS (SELECT k.*, alw - lw AS olw, alb - lb AS olb, abw - bw AS obw, abb - bb AS obb FROM k JOIN f USING (facility) WHERE rnk <= coalesce(k, 1)),
g AS (SELECT u, any_value(k) AS k, count(*) AS facilities, any_value(gain * nw) AS excess, CASE WHEN any_value(gain) > 0 THEN sum(pos) / any_value(gain) END AS share, CASE WHEN any_value(ref) > 0 THEN sum(bb) / any_value(ref) ELSE 0 END AS ref_share,
sum(tb - lb) / any_value(nb) AS volume_base, sum(tw - lw) / any_value(nw) AS volume, ln((sum(lw) + 0.5) / (sum(bw) + 1) * (sum(bb) + 1) / (sum(lb) + 0.5)) AS inside, sum(olw) AS olw, sum(olb) AS olb, sum(obw) AS obw, sum(obb) AS obb FROM t GROUP BY u)
SELECT u, k::INT AS k, facilities::INT AS facilities, round(excess, 5) AS excess, round(share, 5) AS share, round(ref_share, 5) AS ref_share, round(volume_base, 4) AS volume_base, round(volume, 4) AS volume, round(inside, 5) AS inside, (olw + olb)::BIGINT AS others,
round(CASE WHEN olw + olb >= 30 AND obw > 0 AND obb > 0 THEN ln((olw + 0.5) / (obw + 1) * (obb + 1) / (olb + 0.5)) END, 5) AS outside FROM g"""
)
def facility_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How nations' change in one brand lies with the suppliers that sold it."""
    r5 = lambda c: F.round(c, 5).alias(c)
    out = ins.evidence(_recorded(spark, sf_dir), F.col("year") >= 1999)
    return out.select("u", "k", F.size("facilities").alias("facilities"), r5("excess"), r5("share"), r5("ref_share"), r4(F.col("volume_base"), "volume_base"), r4(F.col("volume"), "volume"), r5("inside"), "others", r5("outside"))


@query()
def facility_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that evidence reads as."""
    return ins.mechanism(_recorded(spark, sf_dir), F.col("year") >= 1999).select("u", "k", r4(F.col("share"), "share"), F.round("p", 6).alias("p"), "reading")


def _type_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, u, year, x): log ratios of part types' quarterly quantities in nations to what nation and quarter expect."""
    rows = governed(spark, sf_dir).groupBy(F.element_at(F.split("code", r"\|"), 1).alias("field"), "u", (F.col("year") * 4 + F.floor((F.col("month") - 1) / 3)).cast("int").alias("year")).agg(F.sum("wt").alias("y"))
    at = W.partitionBy("u", "year")
    return rows.select("field", "u", "year", F.log((F.col("y") + 0.5) / (F.sum("y").over(at) / F.count("*").over(at) + 0.5)).alias("x"))


@query()
def direct_type_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which relations between part types' courses remain given all others."""
    out = stx.direct_relations(_type_courses(spark, sf_dir))
    return out.select("a", "b", r4(F.col("rho"), "rho"), "frequency", F.round("partial", 3).alias("partial"), "direct", "penalty")


@query()
def pattern_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the pattern of nations' years there in the earlier and the later years?"""
    cells = staged(expected(spark, sf_dir).select("u", "year", "y", "mu"), "patterned")
    return stx.pattern_stability(cells, 1, F.col("year") < 1998).select("k", *[F.round(c, 2).alias(c) for c in ("stability", "first", "second")])
