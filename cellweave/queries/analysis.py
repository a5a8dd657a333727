"""Expectations, departures, error control and relations over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cellweave.operators import departures as d, error_control as ec, expectation as ex, graphs, relations as rel
from cellweave.queries.base import EXPECTED, REC, expected, governed, people, places, query, records
from cellweave.sources.records import table
from cellweave.sources.scratch import staged

r6 = lambda col, name=None: F.round(col, 6).alias(name or col)

_GROUPS = REC + """,
gc AS (SELECT u, (age // 10)::INT AS g, sum(wt)::BIGINT AS y FROM cells GROUP BY ALL),
gn AS (SELECT u, (age // 10)::INT AS g, count(*)::DOUBLE AS n FROM cells GROUP BY ALL)"""


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = governed(spark, sf_dir).withColumn("g", F.expr("cast(age div 10 as int)"))
    return rows.groupBy("u", "g").agg(F.sum("wt").alias("y")), rows.groupBy("u", "g").agg(F.count("*").cast("double").alias("n"))


@query(
    f"""WITH {_GROUPS}, std AS (SELECT g, sum(n) AS std FROM gn GROUP BY ALL)
SELECT gn.u, sum(coalesce(y, 0))::BIGINT AS y, sum(n) AS n, round(sum(coalesce(y, 0)) / sum(n) * 100000, 6) AS crude, round(sum(std * coalesce(y, 0) / n) / sum(std) * 100000, 6) AS standardised
FROM gn LEFT JOIN gc ON gn.u = gc.u AND gn.g = gc.g JOIN std ON gn.g = std.g GROUP BY ALL"""
)
def standardised_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, exposure = _groups(spark, sf_dir)
    return ex.crude_and_standardised(cells, exposure).select("u", "y", "n", r6("crude"), r6("standardised"))


_OE = f"""{_GROUPS}, rate AS (SELECT gn.g, sum(coalesce(y, 0)) / sum(n) AS rate FROM gn LEFT JOIN gc ON gn.u = gc.u AND gn.g = gc.g GROUP BY ALL),
oe AS (SELECT gn.u, sum(coalesce(y, 0))::BIGINT AS observed, sum(n * rate) AS expected FROM gn LEFT JOIN gc ON gn.u = gc.u AND gn.g = gc.g JOIN rate ON gn.g = rate.g GROUP BY ALL)"""


@query(f"WITH {_OE} SELECT u, observed, round(expected, 6) AS expected, round((observed + 0.5) / (expected + 0.5), 6) AS ratio FROM oe")
def indirect_oe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.indirect(*_groups(spark, sf_dir)).select("u", "observed", r6("expected"), r6("ratio"))


@query(
    f"""WITH {_OE}, m AS (SELECT sum(observed) / sum(expected) AS m, sum(expected) AS e, count(*) AS k FROM oe),
v AS (SELECT sum(expected * (observed / expected - m) * (observed / expected - m)) / any_value(e) - any_value(m) * any_value(k) / any_value(e) AS v FROM oe, m)
SELECT u, round((observed + m * m / greatest(v, 1e-9)) / (expected + m / greatest(v, 1e-9)), 6) AS shrunk FROM oe, m, v"""
)
def shrunk_place_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.shrunk_places(ex.indirect(*_groups(spark, sf_dir))).select("u", r6("shrunk"))


@query(
    f"""WITH {EXPECTED}, b AS (SELECT u, year, mu * (1 + 0.01 * u) AS mu1, n AS mu0 FROM expected)
SELECT u, year, round(mu0 * sum(mu1) OVER (PARTITION BY year) / sum(mu0) OVER (PARTITION BY year), 6) AS mu FROM b"""
)
def b0_relevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expected(spark, sf_dir).withColumns({"mu1": F.col("mu") * (1 + 0.01 * F.col("u")), "mu0": F.col("n")})
    return ex.releveled(rows).select("u", "year", r6("mu"))


@query(f"WITH {EXPECTED} SELECT region AS unit, year, sum(y)::BIGINT AS y, round(sum(mu), 6) AS mu, round(sum(mu) * sum(mu) / sum(mu * mu / phi), 6) AS phi FROM expected JOIN places ON expected.u = places.u GROUP BY ALL")
def surprise_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = places(spark, sf_dir).withColumnRenamed("region", "unit")
    return ex.lifted(expected(spark, sf_dir), units).select("unit", "year", "y", r6("mu"), r6("phi"))


@query(f"WITH {EXPECTED} SELECT round(CASE WHEN sum((y - mu) * (y - mu) - mu) > 0 THEN greatest(sum(mu * mu) / sum((y - mu) * (y - mu) - mu), 0.01) ELSE 1e9 END, 6) AS phi FROM expected")
def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.dispersion(expected(spark, sf_dir)).select(r6("phi"))


_IPF = f"""WITH {EXPECTED}, s0 AS (SELECT u, year, y, n AS mu FROM expected)""" + "".join(
    f""", a{i} AS (SELECT u, year, y, CASE WHEN sum(mu) OVER (PARTITION BY u) > 0 THEN mu * sum(y) OVER (PARTITION BY u) / sum(mu) OVER (PARTITION BY u) ELSE 0.0 END AS mu FROM s{i}),
s{i + 1} AS (SELECT u, year, y, CASE WHEN sum(mu) OVER (PARTITION BY year) > 0 THEN mu * sum(y) OVER (PARTITION BY year) / sum(mu) OVER (PARTITION BY year) ELSE 0.0 END AS mu FROM a{i})"""
    for i in range(6)
)


@query(_IPF + " SELECT u, year, round(mu, 5) AS mu FROM s6")
def proportional_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = expected(spark, sf_dir).select("u", "year", "y", "n")
    return ex.proportional_fit(cells, [["u"], ["year"]], sweeps=6, checkpoint_every=3).select("u", "year", F.round("mu", 5).alias("mu"))


@query()
def surprise_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.surprise(expected(spark, sf_dir)).select("u", "year", "y", r6("mu"), r6("pit"), r6("z"), r6("w"))


@query()
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.calibration(ex.surprise(expected(spark, sf_dir)).join(places(spark, sf_dir), "u"), by="region")


_SERIES = f"{EXPECTED}, series AS (SELECT u, year - 1995 AS t, ln((y + 0.5) / (mu + 0.5)) AS x FROM expected)"


@query(
    f"""WITH {_SERIES}, b AS (SELECT u, t, x, avg(t) OVER (PARTITION BY u) AS tm, avg(x) OVER (PARTITION BY u) AS xm FROM series),
f AS (SELECT u, arg_max(x, t) AS level, sum((t - tm) * (x - xm)) / sum((t - tm) * (t - tm)) AS slope, avg(x) AS flat, median(x) AS med FROM b GROUP BY ALL)
SELECT u, round(level + 2 * slope, 6) AS linear, round(level + 0.75 * slope, 6) AS damped, round(flat, 6) AS flat, round(med, 6) AS median FROM f"""
)
def history_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = expected(spark, sf_dir).select("u", (F.col("year") - 1995).alias("t"), F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("x"))
    return ex.forecasts(s, horizon=2).select("u", r6("linear"), r6("damped"), r6("flat"), r6("median"))


#: The negative binomial's upper tail as one less the sum of what lies below y.
@query(
    f"""WITH {EXPECTED}, th AS (SELECT u, year, y, mu, phi, least(1.1, 1 + 0.1 * avg(mu) OVER () / mu) AS theta, mu / avg(mu) OVER () AS w FROM expected),
low AS (SELECT u, year, theta * mu AS m, phi, unnest(range(y)) AS k FROM th), tail AS (SELECT u, year, sum(exp(lgamma(k + phi) - lgamma(phi) - lgamma(k + 1) + phi * ln(phi / (phi + m)) + k * ln(m / (phi + m)))) AS below FROM low GROUP BY ALL),
tp AS (SELECT th.*, concat(th.u, ':', th.year) AS id, greatest(0, 1 - coalesce(below, 0)) AS p FROM th LEFT JOIN tail ON th.u = tail.u AND th.year = tail.year), r AS (SELECT *, row_number() OVER (ORDER BY p / w, id) AS k, count(*) OVER () AS n FROM tp), l AS (SELECT max(k) AS last FROM r WHERE p / w <= 0.1 * k / n)
SELECT u, year, y, round(theta, 6) AS theta, round(p, 6) AS p, round((y + 0.5) / (mu + 0.5), 6) AS ratio, coalesce(k <= last, false) AS rejected FROM r, l"""
)
def outbreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.outbreak(expected(spark, sf_dir), 0.1).select("u", "year", "y", r6("theta"), r6("p"), r6("ratio"), "rejected")


@query()
def change_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.change_point(expected(spark, sf_dir), 0.1).select("u", "since", r6("p"), "rejected")


@query(
    f"""WITH {EXPECTED}, w AS (SELECT u, year, sum(y) OVER a AS y_after, sum(mu) OVER a AS mu_after, sum(mu * mu / phi) OVER a AS v_after, count(*) OVER a AS length, row_number() OVER (PARTITION BY u ORDER BY year) - 1 AS past
FROM expected WINDOW a AS (PARTITION BY u ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT u, year, y_after::BIGINT AS y_after, round(mu_after, 6) AS mu_after, round(v_after, 6) AS v_after, length::BIGINT AS length FROM w WHERE past >= 3 AND length >= 2"""
)
def suffix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.windows(expected(spark, sf_dir)).select("u", "year", "y_after", r6("mu_after"), r6("v_after"), "length")


_SCORE = "CASE WHEN {y} > {m} AND {m} > 0 THEN {y} * ln({y} / {m}) + {m} - {y} ELSE 0.0 END"


@query(
    f"""WITH {EXPECTED}, s AS (SELECT a.u, a.year AS start, b.year - a.year + 1 AS length FROM expected a JOIN expected b ON a.u = b.u AND b.year BETWEEN a.year AND a.year + 2),
t AS (SELECT s.u, start, length, sum(y) AS y, sum(mu) AS mu FROM s JOIN expected e ON e.u = s.u AND e.year BETWEEN start AND start + length - 1 GROUP BY ALL)
SELECT u, start::INT AS start, length::INT AS length, y::BIGINT AS y, round(mu, 6) AS mu, round({_SCORE.format(y="y", m="mu")}, 6) AS score FROM t"""
)
def scan_score_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.window_scores(expected(spark, sf_dir).select("u", "year", "y", "mu"), longest=3).select("u", "start", "length", "y", r6("mu"), r6("score"))


@query(
    f"""WITH {EXPECTED}, p AS (SELECT year, u, sum(y) OVER o AS sy, sum(mu) OVER o AS sm, row_number() OVER o AS size FROM expected WHERE mu > 0 WINDOW o AS (PARTITION BY year ORDER BY y / mu DESC, u)),
s AS (SELECT year, size, {_SCORE.format(y="sy", m="sm")} AS score FROM p)
SELECT year, round(max(score), 6) AS score, arg_max(size, score)::INT AS size FROM s GROUP BY ALL"""
)
def ltss_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.best_prefixes(expected(spark, sf_dir), within=("year",)).select("year", r6("score"), "size")


@query()
def space_time_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.space_time(expected(spark, sf_dir), graphs.neighbourhoods(_flow(spark, sf_dir), 30), longest=4, replicates=200).select("centre", r6("score"), "first", "last", "places", "reported", r6("p"))


@query()
def cell_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.cell_excess(ex.surprise(expected(spark, sf_dir)), 0.1, classes=4).select("u", "year", "class", r6("z0"), r6("p"), "rejected")


_STEP = f"""{EXPECTED}, w AS (SELECT u, year, sum(y) OVER b AS yb, sum(mu) OVER b AS mb, sum(y) OVER a AS ya, sum(mu) OVER a AS ma, count(*) OVER b AS k FROM expected
WINDOW b AS (PARTITION BY u ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY u ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
e AS (SELECT u, year, ln((ya + 0.5) / (ma + 0.5)) - ln((yb + 0.5) / (mb + 0.5)) AS d, 1 / (ya + 0.5) + 1 / (yb + 0.5) AS v FROM w WHERE k >= 2),
f AS (SELECT *, sqrt(v / (v + 1)) * exp(least(500, d * d / 2 * (1 / v - 1 / (v + 1)))) AS bf FROM e),
g AS (SELECT u, avg(bf) AS bf, arg_max(year, bf)::INT AS since, arg_max(d / (v + 1), bf) AS size FROM f GROUP BY ALL)"""


@query(f"WITH {_STEP} SELECT u, since, round(size, 6) AS size, round(0.05 * bf / (0.05 * bf + 0.95), 6) AS posterior FROM g")
def step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.steps(expected(spark, sf_dir)).select("u", "since", r6("size"), r6("posterior"))


@query(f"WITH {_STEP}, p AS (SELECT u, round(0.05 * bf / (0.05 * bf + 0.95), 6) AS posterior FROM g) SELECT u, posterior, avg(1 - posterior) OVER (ORDER BY posterior DESC, u ROWS UNBOUNDED PRECEDING) <= 0.2 AS selected FROM p")
def step_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.bayes_selected(d.steps(expected(spark, sf_dir)).select("u", r6("posterior")), 0.2)


_BETABINOM = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + s * theta) + lgamma(n - k + (1 - s) * theta) - lgamma(n + theta) + lgamma(theta) - lgamma(s * theta) - lgamma((1 - s) * theta))"


@query(
    f"""WITH {REC}, sy AS (SELECT u, year, count(*) AS n, count(*) FILTER (status = 'R') AS y FROM cells GROUP BY ALL), sn AS (SELECT year, sum(y) / sum(n) AS share FROM sy GROUP BY ALL), sc AS (SELECT u, sy.year, y, n, share FROM sy JOIN sn ON sy.year = sn.year WHERE n >= 20),
sz AS (SELECT (y - n * share) / sqrt(n * share * (1 - share)) AS z, n FROM sc WHERE share > 0 AND share < 1), sp AS (SELECT pow((quantile_cont(z, 0.75) - quantile_cont(z, 0.25)) / 1.349, 2) AS s, avg(n) AS n FROM sz), st AS (SELECT CASE WHEN s > 1 THEN greatest(1, (n - 1) / (s - 1) - 1) ELSE 1e6 END AS theta FROM sp),
sk AS (SELECT u, year, y, n, least(greatest(share, 1e-9), 1 - 1e-9) AS s, theta, unnest(range(n + 1)) AS k FROM sc, st), tl AS (SELECT u, year, sum(CASE WHEN k <= y THEN {_BETABINOM} ELSE 0 END) AS low, sum(CASE WHEN k >= y THEN {_BETABINOM} ELSE 0 END) AS high FROM sk GROUP BY ALL),
tp AS (SELECT sc.*, concat(sc.u, ':', sc.year) AS id, least(1, 2 * least(low, high)) AS p, (y + 0.5) / (n * share + 0.5) AS ratio FROM sc JOIN tl ON sc.u = tl.u AND sc.year = tl.year), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM tp), l AS (SELECT max(k) AS last FROM r WHERE p <= 0.1 * k / m)
SELECT u, year, y::BIGINT AS y, n::BIGINT AS n, round(share, 6) AS share, round(p, 6) AS p, round(ratio, 6) AS ratio, coalesce(k <= last, false) AND (ratio >= 1.25 OR ratio <= 1 / 1.25) AS found FROM r, l"""
)
def share_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).groupBy("u", "year").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "R", 1)).alias("y"))
    nat = rows.groupBy("year").agg((F.sum("y") / F.sum("n")).alias("share"))
    return d.share_excess(rows.join(nat, "year"), 0.1).select("u", "year", "y", "n", r6("share"), r6("p"), r6("ratio"), "found")


_FIELDS = f"""{REC}, fy AS (SELECT split_part(code, '|', 1) AS field, u, year, sum(wt)::BIGINT AS y FROM cells GROUP BY ALL),
fields AS (SELECT *, sum(y) OVER (PARTITION BY field) * sum(y) OVER (PARTITION BY u, year) / sum(y) OVER () AS mu FROM fy)"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).groupBy(F.split_part("code", F.lit("|"), F.lit(1)).alias("field"), "u", "year").agg(F.sum("wt").alias("y"))
    one = W.partitionBy(F.lit(0))
    return rows.withColumn("mu", F.sum("y").over(W.partitionBy("field")) * F.sum("y").over(W.partitionBy("u", "year")) / F.sum("y").over(one))


@query(
    f"""WITH {_FIELDS}, p AS (SELECT u, year, sum(y) OVER o AS sy, sum(mu) OVER o AS sm, row_number() OVER o AS k FROM fields WHERE mu > 0 WINDOW o AS (PARTITION BY u, year ORDER BY y / mu DESC, field)),
s AS (SELECT u, year, k, {_SCORE.format(y="sy", m="sm")} AS score FROM p WHERE k >= 2) SELECT u, year, round(max(score), 6) AS score, arg_max(k, score)::INT AS fields FROM s GROUP BY ALL"""
)
def joint_excess_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.joint_scores(_fields(spark, sf_dir)).select("u", "year", r6("score"), "fields")


@query(
    f"""WITH {_GROUPS}, m AS (SELECT gn.u, gn.g, coalesce(y, 0) AS y, n * (SELECT sum(y) FROM gc) / (SELECT sum(n) FROM gn) AS mu FROM gn LEFT JOIN gc ON gn.u = gc.u AND gn.g = gc.g),
p AS (SELECT u, CASE WHEN mu >= 5 THEN g::VARCHAR ELSE 'pooled' END AS g, sum(y) AS y, sum(mu) AS mu FROM m GROUP BY ALL),
e AS (SELECT *, mu * sum(y) OVER (PARTITION BY u) / sum(mu) OVER (PARTITION BY u) AS e FROM p)
SELECT u, round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / e) ELSE 0 END - (y - e)), 6) AS g2, (count(*) - 1)::BIGINT AS df FROM e GROUP BY ALL"""
)
def group_disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, exposure = _groups(spark, sf_dir)
    both = exposure.join(cells, ["u", "g"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    one = W.partitionBy(F.lit(0))
    rows = both.withColumn("mu", F.col("n") * F.sum("y").over(one) / F.sum("n").over(one))
    return d.group_spread(rows).select("u", r6("g2"), "df")


_TREND = f"""{EXPECTED}, tr AS (SELECT u, sum(mu) AS w, sum(mu * year) AS wx, sum(mu * ln((y + 0.5) / (mu + 0.5))) AS wr, sum(mu * year * ln((y + 0.5) / (mu + 0.5))) AS wxr, sum(mu * year * year) AS wxx FROM expected GROUP BY ALL),
trend AS (SELECT u, (wxr - wx * wr / w) / (wxx - wx * wx / w) AS beta, sqrt(1 / (wxx - wx * wx / w)) AS sd FROM tr)"""


@query(f"WITH {_TREND} SELECT u, round(beta, 5) AS beta, round(sd, 5) AS sd FROM trend")
def unit_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.trends(expected(spark, sf_dir)).select("u", F.round("beta", 5).alias("beta"), F.round("sd", 5).alias("sd"))


_FLOW = f"""fl AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
sh AS (SELECT fl.a, fl.b, n / t AS w FROM fl JOIN (SELECT a, sum(n) AS t FROM fl GROUP BY ALL) tt ON fl.a = tt.a WHERE fl.a <> fl.b),
flow AS (SELECT a, b, sum(w) AS weight FROM (SELECT a, b, w FROM sh UNION ALL SELECT b, a, w FROM sh) GROUP BY ALL)"""


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).groupBy(F.col("u").alias("a"), F.col("facility_place").alias("b")).agg(F.count("*").alias("n"))
    return graphs.care_flow(rows)


@query(f"WITH {_FLOW} SELECT a, b, round(weight, 6) AS weight FROM flow")
def care_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir).select("a", "b", r6("weight"))


@query(f"WITH {EXPECTED}, {_FLOW} SELECT a AS u, year, round(sum(weight * (y + 0.5) / (mu + 0.5)) / sum(weight), 6) AS near FROM flow JOIN expected ON flow.b = expected.u GROUP BY ALL")
def neighbour_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = expected(spark, sf_dir).select("u", "year", ((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("value"))
    return graphs.neighbour_mean(values, _flow(spark, sf_dir)).select("u", "year", r6("near"))


@query(
    f"""WITH {_TREND}, {_FLOW} SELECT t.u, round(t.beta - nb.near, 5) AS difference, round(sqrt(t.sd * t.sd + nb.vj), 5) AS sd FROM trend t
JOIN (SELECT a, avg(beta) AS near, sum(sd * sd) / (count(*) * count(*)) AS vj FROM flow JOIN trend ON flow.b = trend.u GROUP BY ALL) nb ON t.u = nb.a"""
)
def trend_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d.divergence(d.trends(expected(spark, sf_dir)), _flow(spark, sf_dir))
    return out.select("u", F.round("difference", 5).alias("difference"), F.round("sd", 5).alias("sd"))


_MONTHS = f"""{REC}, mo AS (SELECT u, year, month, sum(wt) AS y FROM cells GROUP BY ALL), mm AS (SELECT *, sum(y) OVER (PARTITION BY u, year) / 12.0 AS mu FROM mo)"""


@query(
    f"""WITH {_MONTHS} SELECT u, year, round(sum(ln((y + 0.5) / (mu + 0.5)) * sin(2 * pi() * (month - 1) / 12)) / 6, 6) AS sin, round(sum(ln((y + 0.5) / (mu + 0.5)) * cos(2 * pi() * (month - 1) / 12)) / 6, 6) AS cos FROM mm GROUP BY ALL HAVING count(*) = 12"""
)
def year_harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).groupBy("u", "year", "month").agg(F.sum("wt").alias("y"))
    rows = rows.withColumn("mu", F.sum("y").over(W.partitionBy("u", "year")) / 12.0)
    return d.harmonics(rows).select("u", "year", r6("sin"), r6("cos"))


@query(
    f"""WITH {REC}, f AS (SELECT facility, year, count(*) AS y FROM cells GROUP BY ALL), e AS (SELECT f.facility, f.year, y, ty * yy / tt AS mu FROM f JOIN (SELECT facility, sum(y) AS ty FROM f GROUP BY ALL) a ON f.facility = a.facility JOIN (SELECT year, sum(y) AS yy FROM f GROUP BY ALL) b ON f.year = b.year, (SELECT sum(y) AS tt FROM f)),
s AS (SELECT a.facility, a.year AS first, b.year AS last, sum(e.y) AS o, sum(e.mu) AS m FROM e a JOIN e b ON a.facility = b.facility AND a.year <= b.year JOIN e ON e.facility = a.facility AND e.year BETWEEN a.year AND b.year GROUP BY ALL),
t AS (SELECT facility, sum(y) AS ty, sum(mu) AS tm FROM e GROUP BY ALL),
l AS (SELECT s.facility, first, last, o, m * ty / tm AS e, ty FROM s JOIN t ON s.facility = t.facility),
g AS (SELECT facility, round(2 * (CASE WHEN o > 0 AND e > 0 THEN o * ln(o / e) ELSE 0 END + CASE WHEN ty - o > 0 AND ty - e > 0 THEN (ty - o) * ln((ty - o) / (ty - e)) ELSE 0 END), 5) AS g FROM l)
SELECT facility, max(g) AS g FROM g GROUP BY ALL"""
)
def institution_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = governed(spark, sf_dir).groupBy("facility", "year").agg(F.count("*").alias("y"))
    one = W.partitionBy(F.lit(0))
    cells = per.withColumn("mu", F.sum("y").over(W.partitionBy("facility")) * F.sum("y").over(W.partitionBy("year")) / F.sum("y").over(one))
    return d.institution_windows(cells).select("facility", F.round("g", 5).alias("g"))


#: A place and year's two half-years against all places' rate: the squared scaled residuals' sum, chi-square on 2 degrees
#: of freedom, whose tail is exp(-x / 2).
_P = f"""{EXPECTED}, hy AS (SELECT u, year, (month > 6)::INT AS half, sum(wt) AS y FROM cells GROUP BY ALL),
hg AS (SELECT e.u, e.year, e.n, h.range::INT AS half, coalesce(hy.y, 0) AS y FROM expected e CROSS JOIN range(2) h LEFT JOIN hy ON hy.u = e.u AND hy.year = e.year AND hy.half = h.range),
hm AS (SELECT *, n * sum(y) OVER (PARTITION BY year, half) / sum(n) OVER (PARTITION BY year, half) AS mu FROM hg),
hp AS (SELECT CASE WHEN sum((y - mu) * (y - mu) - mu) > 0 THEN greatest(sum(mu * mu) / sum((y - mu) * (y - mu) - mu), 0.01) ELSE 1e9 END AS phi FROM hm),
tests AS (SELECT hm.u * 10000 + year AS id, hm.u, year, region, round(exp(-sum((y - mu) * (y - mu) / (mu + mu * mu / phi)) / 2), 9) AS p, sum(mu) AS mu FROM hm JOIN places ON hm.u = places.u, hp WHERE mu > 0 GROUP BY ALL)"""


def half_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, year, half, n, y, mu, phi)."""
    cells = governed(spark, sf_dir).groupBy("u", "year", (F.col("month") > 6).cast("int").alias("half")).agg(F.sum("wt").alias("y"))
    grid = expected(spark, sf_dir).select("u", "year", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    rows = grid.join(cells, ["u", "year", "half"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    w = W.partitionBy("year", "half")
    rows = staged(rows.withColumn("mu", F.col("n") * F.sum("y").over(w) / F.sum("n").over(w)), "halves")
    return rows.crossJoin(ex.dispersion(rows))  # one row


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = half_years(spark, sf_dir).where("mu > 0").join(places(spark, sf_dir), "u")
    x = (F.col("y") - F.col("mu")) ** 2 / (F.col("mu") + F.col("mu") ** 2 / F.col("phi"))
    per = rows.groupBy("u", "year", "region").agg(F.round(F.exp(-F.sum(x) / 2), 9).alias("p"), F.sum("mu").alias("mu"))
    return per.select((F.col("u") * 10000 + F.col("year")).alias("id"), "u", "year", "region", "p", "mu")


def _bh_sql(q: float, value: str = "p", c: str = "1.0") -> str:
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY {value}, id) AS k, count(*) OVER () AS m FROM tests), h AS (SELECT *, {c} AS c FROM r), l AS (SELECT max(k) AS last FROM h WHERE {value} <= {q} * k / (m * c))
SELECT id, p, coalesce(k <= last, false) AS rejected FROM h, l"""


@query(f"WITH {_P}, {_bh_sql(0.2)}")
def bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ec.bh(_tests(spark, sf_dir), 0.2).select("id", "p", "rejected")


@query(f"WITH {_P}, {_bh_sql(0.5, c='sum(1.0 / k) OVER ()')}")
def bh_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ec.bh(_tests(spark, sf_dir), 0.5, dependent=True).select("id", "p", "rejected")


@query(f"WITH {_P.replace('tests AS (', 'unweighed AS (')}, tests AS (SELECT *, mu / avg(mu) OVER () AS w FROM unweighed), {_bh_sql(0.2, 'p / w')}")
def bh_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ec.bh(_tests(spark, sf_dir), 0.2, weight="mu").select("id", "p", "rejected")


@query(f"WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM tests) SELECT id, round(least(1.0, min(p * m / k) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM r")
def bh_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ec.adjusted(_tests(spark, sf_dir)).select("id", r6("q_value"))


_SIMES = f"{_P}, rs AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY p, id) AS k, count(*) OVER (PARTITION BY u) AS m FROM tests), fam AS (SELECT u, min(p * m / k) AS fp FROM rs GROUP BY ALL)"


@query(f"WITH {_SIMES} SELECT u, round(fp, 6) AS p FROM fam")
def simes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ec.simes(_tests(spark, sf_dir), by=("u",)).select("u", r6("p"))


@query(
    f"""WITH {_SIMES}, fr AS (SELECT *, row_number() OVER (ORDER BY fp, u) AS k, count(*) OVER () AS m FROM fam), fl AS (SELECT coalesce(max(k), 0) AS last FROM fr WHERE fp <= 0.4 * k / m),
sel AS (SELECT u, k <= last AS chosen, 0.4 * last / m AS q FROM fr, fl), lim AS (SELECT rs.u, max(CASE WHEN p <= q * k / m THEN k END) AS last FROM rs JOIN sel ON rs.u = sel.u GROUP BY ALL)
SELECT id, coalesce(chosen AND k <= last, false) AS rejected FROM rs JOIN sel ON rs.u = sel.u JOIN lim ON rs.u = lim.u"""
)
def bogomolov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ec.bogomolov(_tests(spark, sf_dir), 0.4, family="u").select("id", "rejected")


def _level(name: str, keys: str, parents: str, q: str, source: str) -> str:
    """SQL of one level of hierarchical BH: Simes values of the nodes ``keys`` of ``source``, BH among the children of ``parents``."""
    part = f"PARTITION BY {parents}" if parents else ""
    return f"""{name}_s AS (SELECT {keys}, {q} AS lev, min(p * m / k) AS np FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY p, id) AS k, count(*) OVER (PARTITION BY {keys}) AS m FROM {source}) GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER ({part} ORDER BY np, {keys.split(", ")[-1]}) AS k, count(*) OVER ({part}) AS m FROM {name}_s), {name}_l AS (SELECT *, max(CASE WHEN np <= lev * k / m THEN k END) OVER ({part}) AS last FROM {name}_r),
{name} AS (SELECT {keys}, lev * last / m AS lev FROM {name}_l WHERE k <= last)"""


@query(
    f"""WITH {_P}, {_level("ra", "region", "", "0.5", "tests")}, inside AS (SELECT tests.*, ra.lev FROM tests JOIN ra ON tests.region = ra.region), {_level("ua", "region, u", "region", "lev", "inside")},
lr AS (SELECT tests.id, p, ua.lev, row_number() OVER (PARTITION BY tests.u ORDER BY p, id) AS k, count(*) OVER (PARTITION BY tests.u) AS m FROM tests JOIN ua ON tests.u = ua.u), ll AS (SELECT *, max(CASE WHEN p <= lev * k / m THEN k END) OVER (PARTITION BY id // 10000) AS last FROM lr)
SELECT tests.id, region, u, tests.p, coalesce(ll.k <= ll.last, false) AS rejected FROM tests LEFT JOIN ll ON tests.id = ll.id"""
)
def tree_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ec.tree_bh(_tests(spark, sf_dir), ["region", "u"], 0.5).select("id", "region", "u", "p", "rejected")


_SCALE = 1 / sum(1 / (i * math.log(i + 1) ** 2) for i in range(1, 100_001))


@query(
    f"""WITH RECURSIVE {_P}, o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY year) AS i FROM tests),
f AS (SELECT id, u, p, i, {_SCALE!r} * 0.5 / (i * ln(i + 1) * ln(i + 1)) AS level, (p <= {_SCALE!r} * 0.5 / (i * ln(i + 1) * ln(i + 1)))::INT AS found FROM o WHERE i = 1
UNION ALL SELECT o.id, o.u, o.p, o.i, {_SCALE!r} * 0.5 / (o.i * ln(o.i + 1) * ln(o.i + 1)) * (f.found + 1), f.found + (o.p <= {_SCALE!r} * 0.5 / (o.i * ln(o.i + 1) * ln(o.i + 1)) * (f.found + 1))::INT FROM f JOIN o ON o.u = f.u AND o.i = f.i + 1)
SELECT id, p, round(level, 6) AS level, p <= level AS rejected FROM f"""
)
def lond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ec.lond(_tests(spark, sf_dir), 0.5, order="year", by="u").select("id", "p", r6("level"), "rejected")


@query(f"WITH {_P}, a AS (SELECT DISTINCT id FROM tests), b AS (SELECT id, p FROM tests WHERE year >= 1998) SELECT a.id, coalesce(b.p, 1.0) AS p FROM a LEFT JOIN b ON a.id = b.id")
def ledger_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _tests(spark, sf_dir)
    return ec.ledger_family(tests.select("id"), tests.where("year >= 1998").select("id", "p", F.col("year").alias("at")))


_X = f"{_FIELDS}, x AS (SELECT field, u, year, ln((y + 0.5) / (mu + 0.5)) AS x, mu AS w FROM fields)"


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("field", "u", "year", F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("x"), F.col("mu").alias("w"))


@query(
    f"""WITH {_X}, lg AS (SELECT range AS lag FROM range(3)), m AS (SELECT a.field, b.field AS leader, lag, sqrt(a.w * b.w) AS w, a.x, b.x AS y FROM x a JOIN lg ON true JOIN x b ON a.u = b.u AND a.year = b.year + lag WHERE a.field <> b.field AND (lag > 0 OR a.field > b.field)),
s AS (SELECT field, leader, lag, sum(w) AS n, sum(w * w) AS nn, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy, sum(w * x * y) AS sxy FROM m GROUP BY ALL)
SELECT field, leader, lag::INT AS lag, round((sxy / n - sx * sy / (n * n)) / sqrt((sxx / n - sx * sx / (n * n)) * (syy / n - sy * sy / (n * n))), 6) AS rho, round(n * n / nn, 5) AS n_eff FROM s"""
)
def weighted_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.weighted_correlations(_x(spark, sf_dir), lags=2).select("field", "leader", "lag", r6("rho"), F.round("n_eff", 5).alias("n_eff"))


#: The normal's tail beyond z by the series of its distribution function around 0.
_NORMAL_TAIL = "greatest(0, 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(exp((2 * j + 1) * ln(z) - lgamma(2 * j + 2) + j * ln(2) + lgamma(j + 1))) FROM range(300) x(j)))"


@query(
    f"""WITH {_X}, pm AS (SELECT a.field, b.field AS leader, sqrt(a.w * b.w) AS w, a.x, b.x AS y FROM x a JOIN x b ON a.u = b.u AND a.year = b.year AND a.field > b.field), ps AS (SELECT field, leader, sum(w) AS n, sum(w * w) AS nn, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy, sum(w * x * y) AS sxy FROM pm GROUP BY ALL),
pr AS (SELECT field, leader, (sxy / n - sx * sy / (n * n)) / sqrt((sxx / n - sx * sx / (n * n)) * (syy / n - sy * sy / (n * n))) AS rho, n * n / nn AS n_eff FROM ps), pz AS (SELECT *, (ln((1 + abs(rho)) / (1 - abs(rho))) / 2 - ln(1.03 / 0.97) / 2) * sqrt(greatest(n_eff - 3, 0)) AS z FROM pr),
pp AS (SELECT *, CASE WHEN z > 0 THEN 2 * {_NORMAL_TAIL} ELSE 1.0 END AS p, concat(field, ':', leader) AS id FROM pz), pk AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM pp)
SELECT field, leader, round(rho, 6) AS rho, round(z, 6) AS z, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM pk"""
)
def pair_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = rel.pair_test(rel.weighted_correlations(_x(spark, sf_dir)), delta=0.03)
    return ec.adjusted(pairs.withColumn("id", F.concat_ws(":", "field", "leader"))).select("field", "leader", r6("rho"), r6("z"), r6("p"), r6("q_value"))


@query(f"WITH {_X}, lg AS (SELECT range AS lag FROM range(3)) SELECT field, u, (year + lag)::INT AS year, lag::INT AS lag, round(x, 6) AS x FROM x, lg")
def lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.lagged(_x(spark, sf_dir), 2).select("field", "u", "year", "lag", r6("x"))


@query(
    f"""WITH {_X}, l AS (SELECT a.field, a.u, a.year, a.x, b.x AS px, a.w FROM x a JOIN x b ON a.field = b.field AND a.u = b.u AND a.year = b.year + 1), c AS (SELECT field, sum(x * px) / sum(px * px) AS a FROM l GROUP BY ALL)
SELECT l.field, u, year, round(x - a * px, 6) AS x FROM l JOIN c ON l.field = c.field"""
)
def prewhitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.prewhitened(_x(spark, sf_dir)).select("field", "u", "year", r6("x"))


@query(
    f"""WITH {_X}, n AS (SELECT year, x, w FROM x), r AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY x) + (count(*) OVER (PARTITION BY year, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY year ORDER BY w) + (count(*) OVER (PARTITION BY year, w) - 1) / 2 AS ry FROM n)
SELECT year, round(corr(rx, ry), 6) AS rho, count(*)::BIGINT AS n FROM r GROUP BY ALL"""
)
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.rank_correlation(_x(spark, sf_dir), "x", "w", by=("year",)).select("year", r6("rho"), "n")


@query()
def normal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.normal_scores(_x(spark, sf_dir), "x", by=("field",)).select("field", "u", "year", r6("score"))


@query()
def distributed_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = expected(spark, sf_dir)
    s = s.withColumn("x", F.log((F.lag("y").over(W.partitionBy("u").orderBy("year")) + 0.5) / (F.col("mu") + 0.5))).where("x is not null")
    return rel.distributed_lag(s, 2).select("lag", r6("beta"), r6("sd"))


@query()
def poisson_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = rel.poisson_factors(expected(spark, sf_dir).select("u", "year", "y", "mu"), 1)
    return a.select("u", "k", r6("a"))


@query(f"WITH {REC}, h AS (SELECT DISTINCT u, row_number() OVER (ORDER BY u) AS k FROM (SELECT DISTINCT u FROM cells)) SELECT region, count(DISTINCT cells.u)::BIGINT AS places, sum(wt)::BIGINT AS y FROM cells JOIN places ON cells.u = places.u GROUP BY ALL")
def scales_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).join(places(spark, sf_dir), "u")
    return rows.groupBy("region").agg(F.count_distinct("u").alias("places"), F.sum("wt").alias("y"))


_TREE = """tree AS (SELECT DISTINCT concat(p_type, '|', p_brand) AS code, p_type AS parent FROM part UNION SELECT DISTINCT p_type, 'all' FROM part UNION SELECT 'all', NULL)"""


@query(f"WITH RECURSIVE {_TREE}, w AS (SELECT code AS node, code AS leaf, 0 AS distance FROM tree UNION ALL SELECT tree.parent, leaf, distance + 1 FROM w JOIN tree ON w.node = tree.code WHERE tree.parent IS NOT NULL) SELECT node, leaf, distance::INT AS distance FROM w")
def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    tree = part.select(F.concat("p_type", F.lit("|"), "p_brand").alias("code"), F.col("p_type").alias("parent")).union(part.select("p_type", F.lit("all"))).distinct()
    tree = tree.union(spark.range(1).select(F.lit("all"), F.lit(None).cast("string")))
    return graphs.closure(tree)


@query("WITH o AS (SELECT l_suppkey, s_nationkey, l_returnflag = 'R' AS a, l_quantity > 25 AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT round(sum((a AND b)::INT) / least(sum(a::INT), sum(b::INT)), 6) AS overlap FROM o")
def field_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.overlap(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", F.col("l_quantity") > 25).select(r6("overlap"))
