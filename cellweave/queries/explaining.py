"""Shapes, attribution, confirmation, controls and power over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cellweave.operators import explain as xp, noise as no
from cellweave.queries.analysis import _FIELDS, _FLOW, _fields, _flow
from cellweave.queries.base import EXPECTED, REC, expected, governed, places, query, records
from cellweave.sources.scratch import staged

r6 = lambda col, name=None: F.round(col, 6).alias(name or col)

_RES = f"{EXPECTED}, res AS (SELECT *, (y - mu) / sqrt(mu + mu * mu / phi) AS z FROM expected)"
_SER = f"{EXPECTED}, ser AS (SELECT u, year, ln((y + 0.5) / (mu + 0.5)) AS x FROM expected)"


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expected(spark, sf_dir).withColumn("z", xp.scaled_residual())


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expected(spark, sf_dir).select("u", "year", F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("x"))


@query(f"WITH {EXPECTED} SELECT u, year, round((pow(y / mu, 1 / 3.0) - (1 - (1 / mu + 1 / phi) / 9)) / sqrt((1 / mu + 1 / phi) / 9), 6) AS z FROM expected")
def gamma_tail_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = xp.tail_z(F.col("y"), F.col("mu"), F.col("mu") + F.col("mu") ** 2 / F.col("phi"))
    return expected(spark, sf_dir).select("u", "year", F.round(z, 6).alias("z"))


@query(
    f"""WITH {_RES}, nl AS (SELECT quantile_cont(z, 0.5) AS c, (quantile_cont(z, 0.75) - quantile_cont(z, 0.25)) / 1.349 AS s, count(*) AS k FROM res), z AS (SELECT u, year, (z - c) / s AS z0, k FROM res, nl),
pi AS (SELECT least(1, avg((abs(z0) <= 1)::INT) / 0.6826894921370859) AS pi0 FROM z), b AS (SELECT floor(z0 / 0.5) AS b, count(*) / any_value(k) / 0.5 AS f FROM z GROUP BY ALL)
SELECT u, year, round(z0, 6) AS z0, round(pi0, 6) AS pi0, round(least(1, pi0 * exp(-z0 * z0 / 2) / 2.5066282746310002 / f), 6) AS lfdr FROM z JOIN b ON floor(z0 / 0.5) = b.b, pi"""
)
def two_group_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.empirical_null(_residuals(spark, sf_dir)).select("u", "year", r6("z0"), r6("pi0"), r6("lfdr"))


@query(f"WITH {_RES} SELECT u, year, round(mu + mu * mu * k / phi, 4) AS variance FROM res, (SELECT pow((quantile_cont(z, 0.75) - quantile_cont(z, 0.25)) / 1.349, 2) AS k FROM res)")
def cell_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _residuals(spark, sf_dir)
    k = rows.agg((((F.percentile("z", F.lit(0.75)) - F.percentile("z", F.lit(0.25))) / 1.349) ** 2).alias("k"))
    return rows.crossJoin(k).select("u", "year", F.round(F.col("mu") + F.col("mu") ** 2 * F.col("k") / F.col("phi"), 4).alias("variance"))  # one row


@query(
    f"""WITH {EXPECTED}, v AS (SELECT u, year, (y - mu) / sqrt(mu + mu * mu / phi) AS r, sqrt(mu + mu * mu / phi) AS sd FROM expected), l AS (SELECT *, lag(r) OVER w AS r1, lag(sd) OVER w AS sd1 FROM v WINDOW w AS (PARTITION BY u ORDER BY year)),
rho AS (SELECT sum(r * r1) / sum(r * r) AS rho FROM l) SELECT u, year, round(rho * sd * sd1, 4) AS covariance FROM l, rho WHERE sd1 IS NOT NULL"""
)
def lag_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return no.lag_covariance(expected(spark, sf_dir), 1).select("u", "year", F.round("covariance", 4).alias("covariance"))


@query(
    f"""WITH {_RES} SELECT u, year, abs(z) <= 2 AS background, round((sum(CASE WHEN abs(z) <= 2 THEN y ELSE 0 END) OVER (PARTITION BY u) + 0.5) / (sum(CASE WHEN abs(z) <= 2 THEN mu ELSE 0 END) OVER (PARTITION BY u) + 0.5), 6) AS ratio FROM res"""
)
def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.trimmed_background(expected(spark, sf_dir)).select("u", "year", "background", r6("ratio"))


@query(
    f"""WITH {_SER}, c AS (SELECT u, year, x, x - (sum(x) OVER e - x) / (count(*) OVER e - 1) AS spike, avg(x) OVER a - avg(x) OVER b AS step FROM ser WINDOW e AS (PARTITION BY u), a AS (PARTITION BY u ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (PARTITION BY u ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT u, round(max(spike), 6) AS spike, arg_max(year, spike)::INT AS spike_year, round(max(step), 6) AS step, arg_max(year, step)::INT AS since, round(avg(x), 6) AS level, round(regr_slope(x, year), 6) AS slope FROM c GROUP BY ALL"""
)
def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.contrasts(_series(spark, sf_dir)).select("u", r6("spike"), "spike_year", r6("step"), "since", r6("level"), r6("slope"))


@query(
    f"""WITH {_SER}, e AS (SELECT u, x, year, sum(x * x) OVER e - x * x - pow(sum(x) OVER e - x, 2) / (count(*) OVER e - 1) AS one, coalesce(sum(x * x) OVER b - pow(sum(x) OVER b, 2) / count(*) OVER b, 0) + coalesce(sum(x * x) OVER a - pow(sum(x) OVER a, 2) / count(*) OVER a, 0) AS two
FROM ser WINDOW e AS (PARTITION BY u), a AS (PARTITION BY u ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (PARTITION BY u ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT u, count(*) AS n, var_pop(x) * count(*) AS level, min(one) AS spike, min(two) AS step, regr_syy(x, year) - pow(regr_sxy(x, year), 2) / regr_sxx(x, year) AS line FROM e GROUP BY ALL),
b AS (SELECT u, shape, n * ln(greatest(e, 1e-12) / n) + k * ln(n) AS score FROM (SELECT u, n, level AS e, 'level' AS shape, 1 AS k FROM s UNION ALL SELECT u, n, spike, 'spike', 3 FROM s UNION ALL SELECT u, n, step, 'step', 3 FROM s UNION ALL SELECT u, n, line, 'line', 2 FROM s))
SELECT s.u, round(level, 5) AS level, round(spike, 5) AS spike, round(step, 5) AS step, round(line, 5) AS line, f.shape FROM s JOIN (SELECT u, arg_min(shape, score) AS shape FROM b GROUP BY ALL) f ON s.u = f.u"""
)
def course_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = lambda c: F.round(c, 5).alias(c)
    return xp.shapes(_series(spark, sf_dir)).select("u", five("level"), five("spike"), five("step"), five("line"), "shape")


@query(f"WITH {EXPECTED} SELECT u, round(regr_slope(y - mu, year), 5) AS slope FROM expected GROUP BY ALL")
def excess_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.excess_slope(expected(spark, sf_dir)).select("u", F.round("slope", 5).alias("slope"))


@query(f"WITH {EXPECTED} SELECT region, year, round(sum(n * y), 3) AS y, round(sum(n * mu), 3) AS mu, round(sum(n * n * (mu + mu * mu / phi)), 1) AS variance FROM expected JOIN places ON expected.u = places.u GROUP BY ALL")
def weighted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = xp.weighted_sums(expected(spark, sf_dir).join(places(spark, sf_dir), "u"), F.col("n"), ["region", "year"])
    return rows.select("region", "year", F.round("y", 3).alias("y"), F.round("mu", 3).alias("mu"), F.round("variance", 1).alias("variance"))


_NEAR = f"{_FLOW}, nbh AS (SELECT a AS centre, b AS u FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS k FROM flow) WHERE k <= 5 UNION ALL SELECT DISTINCT a, a FROM flow)"


@query(
    f"""WITH {EXPECTED}, {_NEAR}, t AS (SELECT u, sum(y) AS y, sum(mu) AS mu FROM expected GROUP BY ALL), p AS (SELECT centre, sum(y) OVER o AS sy, sum(mu) OVER o AS sm, row_number() OVER o AS k FROM nbh JOIN t ON nbh.u = t.u WINDOW o AS (PARTITION BY centre ORDER BY y / mu DESC, t.u)),
s AS (SELECT centre, k, CASE WHEN sy > sm AND sm > 0 THEN sy * ln(sy / sm) + sm - sy ELSE 0.0 END AS score FROM p) SELECT centre, round(max(score), 5) AS score, arg_max(k, score)::INT AS size FROM s GROUP BY ALL"""
)
def spatial_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = staged(_flow(spark, sf_dir), "flow")
    near = flow.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy(F.desc("weight"), "b"))).where("k <= 5").select(F.col("a").alias("centre"), F.col("b").alias("u"))
    near = near.union(flow.select("a", "a").distinct())
    return xp.spatial_clusters(expected(spark, sf_dir), near).select("centre", F.round("score", 5).alias("score"), "size")


@query(
    f"""WITH {_FIELDS}, r AS (SELECT field, u, year, y, mu, sum(y) OVER w - y AS y2, sum(mu) OVER w - mu AS m2 FROM fields WINDOW w AS (PARTITION BY u, year))
SELECT field, u, round(corr(ln((y + 0.5) / (mu + 0.5)), ln((y2 + 0.5) / (m2 + 0.5))), 6) AS rho, count(*)::BIGINT AS years FROM r WHERE m2 > 0 GROUP BY ALL"""
)
def pool_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.exchange(_fields(spark, sf_dir)).select("field", "u", r6("rho"), "years")


_PROFILE = f"{REC}, pr AS (SELECT split_part(code, '|', 1) AS field, sex * 10 + age // 20 AS g, count(*) FILTER (year < 1999) AS n, count(*) FILTER (year >= 1999) AS y FROM cells GROUP BY ALL)"


@query(
    f"""WITH {_PROFILE}, s AS (SELECT field, g, n, y, sum(n) OVER (PARTITION BY field) AS f, sum(n) OVER (PARTITION BY g) AS gg, sum(n) OVER () AS t, (SELECT count(DISTINCT g) FROM pr) AS k FROM pr)
SELECT field, round(sum(y * ln((n + 0.5) / (f + 0.5 * k) / ((gg - n + 0.5) / (t - f + 0.5 * k))) / 2.302585092994046), 5) AS log10_ratio FROM s GROUP BY ALL"""
)
def recoded_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).groupBy(F.split_part("code", F.lit("|"), F.lit(1)).alias("field"), F.expr("sex * 10 + age div 20").alias("g"))
    rows = staged(rows.agg(F.count(F.when(F.col("year") < 1999, 1)).alias("n"), F.count(F.when(F.col("year") >= 1999, 1)).alias("y")), "profiles")
    return xp.recoded_profile(rows.select("field", "g", "n"), rows.select("field", "g", "y")).select("field", F.round("log10_ratio", 5).alias("log10_ratio"))


@query(
    f"""WITH {REC}, yr AS (SELECT count(DISTINCT year) FILTER (year >= 1999) AS w, count(DISTINCT year) FILTER (year < 1999) AS b FROM cells), f AS (SELECT u, facility, count(*) FILTER (year >= 1999) AS i, count(*) FILTER (year < 1999) AS o FROM cells GROUP BY ALL),
c AS (SELECT u, facility, i - o * w / b AS change FROM f, yr), k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY change DESC, facility) AS k, sum(change) OVER (PARTITION BY u) AS total, sum(greatest(change, 0)) OVER (PARTITION BY u) AS rise FROM c)
SELECT u, facility, round(change, 5) AS own, round(total, 5) AS change, round(change / nullif(rise, 0), 6) AS share FROM k WHERE k = 1"""
)
def facility_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(governed(spark, sf_dir).groupBy("u", "facility", "year").agg(F.count("*").alias("y")), "facilities")
    return xp.facility_read(rows, F.col("year") >= 1999).select("u", "facility", F.round("own", 5).alias("own"), F.round("change", 5).alias("change"), r6("share"))


@query(
    f"""WITH {REC}, f AS (SELECT facility, split_part(code, '|', 1) AS field, count(*) FILTER (year >= 1999) AS i, count(*) FILTER (year < 1999) AS o FROM cells GROUP BY ALL),
r AS (SELECT facility, field, (i + 0.5) / (o + 0.5) AS own, (sum(i) OVER (PARTITION BY facility) + 0.5) / (sum(o) OVER (PARTITION BY facility) + 0.5) AS volume FROM f)
SELECT facility, field, round(own, 6) AS own, round(volume, 6) AS volume, CASE WHEN own < 1.5 * least(1, volume) THEN 'none' WHEN own >= 1.5 * volume THEN 'specific' ELSE 'volume' END AS class FROM r"""
)
def institution_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).groupBy("facility", F.split_part("code", F.lit("|"), F.lit(1)).alias("field"), "year").agg(F.count("*").alias("y"))
    return xp.institution_triage(rows, F.col("year") >= 1999).select("facility", "field", r6("own"), r6("volume"), "class")


@query(
    f"""WITH {REC}, yr AS (SELECT count(DISTINCT year) FILTER (year >= 1999) AS w, count(DISTINCT year) FILTER (year < 1999) AS b FROM cells),
s AS (SELECT u, count(*) FILTER (year >= 1999 AND status = 'R') AS k1, count(*) FILTER (year < 1999 AND status = 'R') AS k0, count(*) FILTER (year >= 1999) AS n1, count(*) FILTER (year < 1999) AS n0 FROM cells GROUP BY ALL),
r AS (SELECT u, k1, (k1 + 0.5) / (n1 + 1) / ((k0 + 0.5) / (n0 + 1)) AS ratio, n1 / w / (n0 / b) AS total FROM s, yr)
SELECT u, round(ratio, 6) AS ratio, round(total, 6) AS total, CASE WHEN k1 < 30 THEN 'noise' WHEN total >= 1.5 OR total <= 1 / 1.5 THEN 'denominator' WHEN ratio >= 1.25 OR ratio <= 0.8 THEN 'signal' ELSE 'noise' END AS class FROM r"""
)
def share_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).groupBy("u", "year").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "R", 1)).alias("k"))
    return xp.share_triage(staged(rows, "shares"), F.col("year") >= 1999).select("u", r6("ratio"), r6("total"), "class")


@query(f"WITH {EXPECTED}, r AS (SELECT region, mu, ln((y + 0.5) / (mu + 0.5)) AS r FROM expected JOIN places ON expected.u = places.u) SELECT region, round(sqrt(sum(mu * r * r) / sum(mu) - pow(sum(mu * r) / sum(mu), 2)), 6) AS spread, count(*)::BIGINT AS groups FROM r GROUP BY ALL")
def ratio_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.log_ratio_spread(expected(spark, sf_dir).join(places(spark, sf_dir), "u"), "region").select("region", r6("spread"), "groups")


@query(f"WITH {REC} SELECT facility, count(*) FILTER (split_part(code, '|', 1) = 'STANDARD' AND u % 5 = 0 AND year >= 1999) AS lead_inside, count(*) FILTER (split_part(code, '|', 1) = 'STANDARD' AND NOT (u % 5 = 0 AND year >= 1999)) AS lead_outside, count(*) FILTER (u % 5 = 0 AND year >= 1999) AS inside, count(*) AS \"all\" FROM cells GROUP BY ALL")
def facility_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.tally(governed(spark, sf_dir), F.split_part("code", F.lit("|"), F.lit(1)) == "STANDARD", (F.col("u") % 5 == 0) & (F.col("year") >= 1999))


@query(
    f"""WITH {EXPECTED}, s AS (SELECT sum(y)::DOUBLE AS y, sum(mu) AS mu, sum(mu + mu * mu / phi) AS v FROM expected WHERE u % 5 = 0 AND year >= 2000)
SELECT round(y, 3) AS y, round(mu, 4) AS mu, round((y + 0.5) / (mu + 0.5), 6) AS ratio, round((pow(y / mu, 1 / 3.0) - (1 - v / (mu * mu) / 9)) / sqrt(v / (mu * mu) / 9), 5) AS z FROM s"""
)
def later_years_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = xp.fixed_test(expected(spark, sf_dir), (F.col("u") % 5 == 0) & (F.col("year") >= 2000))
    return out.select(F.round("y", 3).alias("y"), F.round("mu", 4).alias("mu"), r6("ratio"), F.round("z", 5).alias("z"))


@query(
    f"""WITH {REC}, f AS (SELECT split_part(code, '|', 1) AS pool, code AS field, sum(wt) FILTER (year >= 1999) AS i, sum(wt) FILTER (year < 1999) AS o FROM cells GROUP BY ALL),
r AS (SELECT pool, field, (coalesce(i, 0) + 0.5) / (coalesce(o, 0) + 0.5) AS own, (sum(i) OVER (PARTITION BY pool) + 0.5) / (sum(o) OVER (PARTITION BY pool) + 0.5) AS conserved FROM f)
SELECT pool, field, round(own, 6) AS own, round(conserved, 6) AS conserved, CASE WHEN abs(ln(conserved)) >= abs(ln(own)) / 2 THEN 'kept' ELSE 'moved within' END AS reading FROM r"""
)
def conserved_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).select(F.split_part("code", F.lit("|"), F.lit(1)).alias("pool"), F.col("code").alias("field"), "year", F.col("wt").alias("y"))
    return xp.conserved_level(rows, F.col("year") >= 1999).select("pool", "field", r6("own"), r6("conserved"), "reading")


@query(
    f"""WITH {REC}, a AS (SELECT u, count(*) FILTER (reason IS NOT NULL AND year >= 1999) AS b1, count(*) FILTER (reason IS NULL AND year >= 1999) AS g1, count(*) FILTER (reason IS NOT NULL AND year < 1999) AS b0, count(*) FILTER (reason IS NULL AND year < 1999) AS g0 FROM routed GROUP BY ALL),
r AS (SELECT u, (b1 + 0.5) / (b1 + g1 + 1) / ((b0 + 0.5) / (b0 + g0 + 1)) AS l, (g1 + 0.5) / (g0 + 0.5) AS c FROM a)
SELECT u, round(l, 6) AS left_out, round(c, 6) AS counted, CASE WHEN l >= 1.5 OR l <= 1 / 1.5 THEN 'strong' WHEN l >= 1.2 OR l <= 1 / 1.2 THEN 'weak' ELSE 'none' END AS grade FROM r"""
)
def recording_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.operators.counts import routed

    rows = routed(records(spark, sf_dir), places(spark, sf_dir))
    return xp.recording_audit(rows, F.col("year") >= 1999).select("u", r6("left_out"), r6("counted"), "grade")


_FOUND = f"{_RES}, found AS (SELECT u * 10000 + year AS id, u, year AS first, year + 1 AS last, CASE WHEN z > 0 THEN 1 ELSE -1 END AS direction FROM res WHERE abs(z) > 0.7)"


@query(f"WITH {_FOUND} SELECT a.id, b.id AS other, round((least(a.last, b.last) - greatest(a.first, b.first) + 1) / (greatest(a.last, b.last) - least(a.first, b.first) + 1), 6) AS overlap FROM found a JOIN found b ON a.u = b.u AND a.direction = b.direction AND a.first <= b.last AND b.first <= a.last AND a.id <> b.id")
def same_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _residuals(spark, sf_dir).where(F.abs("z") > 0.7).select((F.col("u") * 10000 + F.col("year")).alias("id"), "u", F.col("year").alias("first"), (F.col("year") + 1).alias("last"), F.when(F.col("z") > 0, 1).otherwise(-1).alias("direction"))
    return xp.same_finding(f, f).select("id", "other", r6("overlap"))


_LEADS = f"{EXPECTED}, leads AS (SELECT u, ln((sum(y) + 0.5) / (sum(mu) + 0.5)) AS effect FROM expected WHERE year < 1999 GROUP BY ALL)"


@query(
    f"""WITH {_LEADS}, s AS (SELECT u, sum(y) AS y, sum(mu) AS mu, sum(mu + mu * mu / phi) AS v FROM expected WHERE year >= 1999 GROUP BY ALL), r AS (SELECT leads.u, effect, ln((y + 0.5) / (mu + 0.5)) AS later, ln((y + 0.5) / (mu + 0.5)) * mu / sqrt(v) AS z FROM leads JOIN s ON leads.u = s.u)
SELECT u, round(effect, 6) AS effect, round(later, 6) AS later, round(z, 5) AS z, sign(later) = sign(effect) AND abs(later) >= abs(effect) / 2 AND z * sign(effect) >= 1.6448536269514722 AS confirmed FROM r"""
)
def temporal_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = expected(spark, sf_dir)
    leads = e.where("year < 1999").groupBy("u").agg(F.log((F.sum("y") + 0.5) / (F.sum("mu") + 0.5)).alias("effect"))
    return xp.confirmed(e, leads, F.col("year") >= 1999).select("u", r6("effect"), r6("later"), F.round("z", 5).alias("z"), "confirmed")


@query("WITH k AS (SELECT l_suppkey AS id, CASE l_returnflag WHEN 'R' THEN 'time' WHEN 'A' THEN 'space' ELSE 'none' END AS kind FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT l_suppkey, 'source' FROM lineitem WHERE l_discount > 0.0999) SELECT id, CASE WHEN bool_or(kind = 'source') THEN 3 WHEN bool_or(kind = 'space') THEN 2 WHEN bool_or(kind = 'time') THEN 1 ELSE 0 END AS tier FROM k GROUP BY ALL")
def replication_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.sources.records import table

    rows = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "time").when(F.col("l_returnflag") == "A", "space").otherwise("none")
    kinds = rows.where("l_quantity > 40").select(F.col("l_suppkey").alias("id"), kind.alias("kind")).union(rows.where("l_discount > 0.0999").select("l_suppkey", F.lit("source")))
    return xp.tier(kinds).select("id", "tier")


@query("WITH r AS (SELECT o_orderkey, o_custkey AS claim, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT o_orderkey, claim, k = 1 AS granted FROM r")
def reserve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.sources.records import table

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("claim"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return xp.spend_once(rows).drop("at")


_COMMON = f"{_FIELDS}, c AS (SELECT field, u, year, ln((y + 0.5) / (mu + 0.5)) AS x, sum(y) OVER (PARTITION BY u, year)::DOUBLE AS z FROM fields)"


@query(
    f"""WITH {_COMMON}, p AS (SELECT a.field AS a, b.field AS b, count(*) AS n, corr(a.x, b.x) AS r, corr(a.x, a.z) AS xz, corr(b.x, a.z) AS yz FROM c a JOIN c b ON a.u = b.u AND a.year = b.year AND a.field < b.field GROUP BY ALL)
SELECT a, b, n::BIGINT AS n, round(r, 6) AS rho, round((r - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS direct FROM p"""
)
def direct_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fields(spark, sf_dir).withColumns({"x": F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)), "z": F.sum("y").over(W.partitionBy("u", "year")).cast("double")})
    return xp.conditional_pairs(staged(rows, "common"), "z").select("a", "b", "n", r6("rho"), r6("direct"))


@query(
    f"""WITH {_FIELDS}, p AS (SELECT field, year, ln((sum(y) + 0.5) / (sum(mu) + 0.5)) AS x FROM fields GROUP BY ALL), l AS (SELECT field, regr_slope(x, year) AS b, regr_intercept(x, year) AS a FROM p GROUP BY ALL), r AS (SELECT p.field, year, x - a - b * year AS x FROM p JOIN l ON p.field = l.field)
SELECT a.field AS a, b.field AS b, round(corr(a.x, b.x), 5) AS rho, count(*)::BIGINT AS years FROM r a JOIN r b ON a.year = b.year AND a.field < b.field GROUP BY ALL"""
)
def course_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.course_pairs(_fields(spark, sf_dir)).select("a", "b", F.round("rho", 5).alias("rho"), "years")


@query(
    f"""WITH {EXPECTED}, t AS (SELECT unnest([1.2, 1.5, 2.0])::DOUBLE AS theta), p AS (SELECT theta, floor(log10(mu))::INT AS size, ((round(y * theta) - mu) / sqrt(mu + mu * mu / phi) > 2)::INT AS hit FROM expected, t) SELECT theta, size, round(avg(hit), 6) AS power, count(*)::BIGINT AS cells FROM p GROUP BY ALL"""
)
def detection_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.detection_power(expected(spark, sf_dir), [1.2, 1.5, 2.0]).select("theta", "size", r6("power"), "cells")


@query(f"WITH {EXPECTED}, m AS (SELECT u, year, n, CASE WHEN u % 5 = 0 THEN y * 0.5 ELSE 0 END AS more FROM expected), r AS (SELECT u, more, n * sum(more) OVER (PARTITION BY year) / sum(n) OVER (PARTITION BY year) AS rise FROM m) SELECT round(sum(rise) / sum(more), 6) AS absorbed, round(sum(more), 3) AS planted FROM r WHERE u % 5 = 0")
def absorbed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.absorbed_share(expected(spark, sf_dir), F.col("u") % 5 == 0, 1.5).select(r6("absorbed"), F.round("planted", 3).alias("planted"))


_NEG = f"""{_FIELDS}, x AS (SELECT field, u, year, ln((y + 0.5) / (mu + 0.5)) AS x FROM fields), i AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT u FROM x)),
neg AS (SELECT a.field AS a, b.field AS b, corr(a.x, b.x) AS rho FROM (SELECT field, (k + 7) % n AS k, year, x FROM x JOIN i ON x.u = i.u) a JOIN (SELECT field, k, year, x FROM x JOIN i ON x.u = i.u) b ON a.k = b.k AND a.year = b.year AND a.field < b.field GROUP BY ALL)"""


def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = staged(_fields(spark, sf_dir).select("field", "u", "year", F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("x")), "series")
    return xp.negative_pairs(x, 7)


@query(f"WITH {_NEG} SELECT a, b, round(rho, 6) AS rho FROM neg")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negatives(spark, sf_dir).select("a", "b", r6("rho"))


@query(f"WITH {_NEG} SELECT round(quantile_cont(abs(rho), 0.9), 6) AS delta, count(*)::BIGINT AS pairs FROM neg")
def calibrated_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xp.least_delta(_negatives(spark, sf_dir), 0.1).select(r6("delta"), "pairs")
