"""Fitted expectations, tiers and scores over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.operators import models as mo
from cellweave.queries.base import EXPECTED, REC, expected, governed, places, query
from cellweave.sources.scratch import staged

r6 = lambda col, name=None: F.round(col, 6).alias(name or col)

#: Counts by place, year, and sex and age band, against a constant exposure by place and group: the records of all years.
_GRID = f"""{REC}, gy AS (SELECT u, year, sex * 10 + age // 20 AS g, sum(wt)::DOUBLE AS y FROM cells GROUP BY ALL), gn AS (SELECT u, sex * 10 + age // 20 AS g, count(*)::DOUBLE AS n FROM cells GROUP BY ALL),
grid AS (SELECT gn.u, gn.g, t.year, n, coalesce(y, 0) AS y FROM gn, (SELECT DISTINCT year FROM cells) t LEFT JOIN gy ON gy.u = gn.u AND gy.g = gn.g AND gy.year = t.year)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(governed(spark, sf_dir).select("u", "year", F.expr("sex * 10 + age div 20").alias("g"), "wt"), "groups")
    n = rows.groupBy("u", "g").agg(F.count("*").cast("double").alias("n"))
    y = rows.groupBy("u", "g", "year").agg(F.sum("wt").cast("double").alias("y"))
    years = rows.select("year").distinct()
    return n.crossJoin(years).join(y, ["u", "g", "year"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))  # a row a year


def _scaled_sql(to: str, source: str, keys: str) -> str:
    return f"{to} AS (SELECT * REPLACE (CASE WHEN sum(mu) OVER (PARTITION BY {keys}) > 0 THEN mu * sum(y) OVER (PARTITION BY {keys}) / sum(mu) OVER (PARTITION BY {keys}) ELSE 0.0 END AS mu) FROM {source})"


_FIT = f"{_GRID}, f0 AS (SELECT *, n AS mu FROM grid)"
for _i in range(3):
    _FIT += f""", {_scaled_sql(f"ft{_i}", f"f{_i}", "year")}, {_scaled_sql(f"fg{_i}", f"ft{_i}", "g")},
fe{_i} AS (SELECT u, sum(y) AS yy, sum(mu) AS mm FROM fg{_i} GROUP BY ALL), fa{_i} AS (SELECT sum(mm) / greatest(sum((yy - mm) * (yy - mm) / mm - 1), 1e-9) AS a FROM fe{_i}),
f{_i + 1} AS (SELECT fg{_i}.* REPLACE (mu * (yy + a) / (mm + a) AS mu) FROM fg{_i} JOIN fe{_i} ON fg{_i}.u = fe{_i}.u, fa{_i})"""
_FIT += f""", {_scaled_sql("ft3", "f3", "year")}, {_scaled_sql("fitted", "ft3", "g")}"""


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.fit(_grid(spark, sf_dir), [["year"], ["g"]], rounds=3)


@query(f"WITH {_FIT} SELECT u, year, sum(y)::BIGINT AS y, round(sum(mu), 4) AS mu FROM fitted GROUP BY ALL")
def model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).groupBy("u", "year").agg(F.sum("y").cast("long").alias("y"), F.round(F.sum("mu"), 4).alias("mu"))


@query(f"WITH {_FIT} SELECT u, g, round(sum(mu), 4) AS mu FROM fitted GROUP BY ALL")
def expected_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).groupBy("u", "g").agg(F.round(F.sum("mu"), 4).alias("mu"))


_VAR = f"{_FIT}, ev AS (SELECT u, year, sum(mu) AS mu, 0.7 * sum(mu * 0.05 * mu * 0.05) + 0.3 * sum(mu * 0.05) * sum(mu * 0.05) AS variance FROM fitted GROUP BY ALL)"


@query(f"WITH {_VAR} SELECT u, year, round(mu, 4) AS mu, round(variance, 3) AS variance FROM ev")
def exposure_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.exposure_variance(_fitted(spark, sf_dir), by=("u", "year"), sd=0.05, rho=0.3).select("u", "year", F.round("mu", 4).alias("mu"), F.round("variance", 3).alias("variance"))


@query(f"WITH {_VAR} SELECT u, year, round(1 / (1 / 20.0 + variance / (mu * mu)), 6) AS phi FROM ev")
def predictive_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = mo.exposure_variance(_fitted(spark, sf_dir), by=("u", "year"), sd=0.05, rho=0.3)
    return v.select("u", "year", F.round(mo.predictive_phi(F.col("mu"), F.col("variance"), F.lit(20.0)), 6).alias("phi"))


@query(f"WITH {EXPECTED}, o AS (SELECT *, CASE WHEN u % 4 = 0 THEN 0.0 ELSE 1.0 END AS out FROM expected) SELECT u, year, round(n * sum(out * y) OVER (PARTITION BY year) / sum(out * n) OVER (PARTITION BY year), 6) AS mu FROM o")
def expected_without_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.without(expected(spark, sf_dir), F.col("u") % 4 == 0).select("u", "year", r6("mu"))


@query(
    f"""WITH {EXPECTED}, d AS (SELECT region, sum((y - mu) * (y - mu) - mu) AS o, sum(mu * mu) AS b, count(*) AS cells FROM expected JOIN places ON expected.u = places.u GROUP BY ALL), a AS (SELECT sum(o) / sum(b) AS every FROM d)
SELECT region, cells::BIGINT AS cells, round(1 / greatest((cells * o / b + 10 * every) / (cells + 10), 1e-9), 5) AS phi FROM d, a"""
)
def dispersion_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.dispersion_by(expected(spark, sf_dir).join(places(spark, sf_dir), "u"), "region").select("region", "cells", F.round("phi", 5).alias("phi"))


@query(f"WITH {EXPECTED}, e AS (SELECT ln(mu) AS x, ln((y - mu) * (y - mu) - mu) AS v FROM expected WHERE mu > 0 AND (y - mu) * (y - mu) > mu) SELECT round(regr_slope(v, x), 5) AS power, round(exp(regr_intercept(v, x)), 5) AS c, count(*)::BIGINT AS cells FROM e")
def dispersion_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.dispersion_power(expected(spark, sf_dir)).select(F.round("power", 5).alias("power"), F.round("c", 5).alias("c"), "cells")


_PHIS = [float(2**k) for k in range(-2, 13)]


@query(
    f"""WITH {EXPECTED}, b AS (SELECT y, exp(round(ln(mu), 2)) AS m, count(*) AS k FROM expected WHERE mu > 0 GROUP BY ALL), ph AS (SELECT pow(2, range - 2)::DOUBLE AS phi FROM range(15))
SELECT phi, round(sum(k * (lgamma(y + phi) - lgamma(phi) - lgamma(y + 1) + phi * ln(phi / (phi + m)) + y * ln(m / (phi + m)))), 4) AS loglik FROM b, ph GROUP BY ALL"""
)
def dispersion_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.binned_likelihood(expected(spark, sf_dir), _PHIS).select("phi", F.round("loglik", 4).alias("loglik"))


_EFFECT = "{y} AS (SELECT u, sum(y) AS yy, sum(mu) AS mm FROM {x} GROUP BY ALL), {y}_a AS (SELECT sum(mm) / greatest(sum((yy - mm) * (yy - mm) / mm - 1), 1e-9) AS a FROM {y})"


@query(
    f"""WITH {EXPECTED}, rt AS (SELECT sum(y) / sum(n) AS r FROM expected WHERE year <= 1999), tr AS (SELECT u, y, n * r AS mu FROM expected, rt WHERE year <= 1999), {_EFFECT.format(y="ef", x="tr")},
te AS (SELECT y, n * r AS m0, n * r * (yy + a) / (mm + a) AS m1 FROM expected JOIN ef ON expected.u = ef.u, rt, ef_a WHERE year > 1999)
SELECT round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / m0) ELSE 0 END - (y - m0)), 3) AS level, round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / m1) ELSE 0 END - (y - m1)), 3) AS places, count(*)::BIGINT AS cells FROM te"""
)
def heldout_deviance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = expected(spark, sf_dir).select("u", "year", "y", "n")
    return mo.heldout(e.where("year <= 1999"), e.where("year > 1999")).select(F.round("level", 3).alias("level"), F.round("places", 3).alias("places"), "cells")


@query(
    f"""WITH {EXPECTED}, rt AS (SELECT sum(y) / sum(n) AS r FROM expected WHERE year <= 1998), tr AS (SELECT u, y, n * r AS mu FROM expected, rt WHERE year <= 1998), {_EFFECT.format(y="ef", x="tr")},
bp AS (SELECT expected.u, year, y, n * r * (yy + a) / (mm + a) AS bp FROM expected JOIN ef ON expected.u = ef.u, rt, ef_a WHERE year > 1998)
SELECT u, year, y, round(bp, 5) AS bp, round(bp * sum(y) OVER (PARTITION BY year) / sum(bp) OVER (PARTITION BY year), 5) AS bpa FROM bp"""
)
def prospective_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mo.prospective(expected(spark, sf_dir).select("u", "year", "y", "n"), 1998)
    return out.select("u", "year", "y", F.round("bp", 5).alias("bp"), F.round("bpa", 5).alias("bpa"))


_NEWTON = f"{EXPECTED}, nb0 AS (SELECT DISTINCT u, 0.0::DOUBLE AS b FROM expected)"
for _i in range(8):
    _NEWTON += f""", nb{_i + 1} AS (SELECT e.u, any_value(b) + (sum((y - mu * exp(b)) / (1 + mu * exp(b) / phi)) - any_value(b)) / (sum(mu * exp(b) / (1 + mu * exp(b) / phi)) + 1) AS b FROM expected e JOIN nb{_i} ON e.u = nb{_i}.u GROUP BY ALL)"""


@query(f"WITH {_NEWTON} SELECT u, round(b, 6) AS level FROM nb8")
def refit_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.refit_places(expected(spark, sf_dir)).select("u", r6("level"))


@query(
    f"""WITH {EXPECTED}, x AS (SELECT u, mu / (1 + mu / phi) AS w, year - (min(year) OVER (PARTITION BY u) + max(year) OVER (PARTITION BY u)) / 2 AS t, ln((y + 0.5) / (mu + 0.5)) AS r FROM expected),
s AS (SELECT u, sum(w) + 1 AS a, sum(w * t) AS b, sum(w * t * t) + 1 AS c, sum(w * r) AS p, sum(w * t * r) AS q FROM x GROUP BY ALL) SELECT u, round((c * p - b * q) / (a * c - b * b), 6) AS level, round((a * q - b * p) / (a * c - b * b), 6) AS slope FROM s"""
)
def ridge_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.ridge_places(expected(spark, sf_dir)).select("u", r6("level"), r6("slope"))


@query(
    f"""WITH {REC}, mo AS (SELECT u, month, sum(wt) AS y FROM cells GROUP BY ALL), mm AS (SELECT *, sum(y) OVER (PARTITION BY u) * sum(y) OVER (PARTITION BY month) / sum(y) OVER () AS mu FROM mo),
x AS (SELECT u, mu AS w, ln((y + 0.5) / (mu + 0.5)) AS r, sin(2 * pi() * (month - 1) / 12) AS s, cos(2 * pi() * (month - 1) / 12) AS c FROM mm) SELECT u, round(sum(w * r * s) / (sum(w * s * s) + 1), 6) AS sin, round(sum(w * r * c) / (sum(w * c * c) + 1), 6) AS cos FROM x GROUP BY ALL"""
)
def season_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    mo_ = staged(governed(spark, sf_dir).groupBy("u", "month").agg(F.sum("wt").alias("y")), "months")
    total = mo_.agg(F.sum("y").alias("_all"))
    rows = mo_.crossJoin(total).withColumn("mu", F.sum("y").over(W.partitionBy("u")) * F.sum("y").over(W.partitionBy("month")) / F.col("_all"))  # one row
    return mo.season_places(rows).select("u", r6("sin"), r6("cos"))


@query(
    f"""WITH {EXPECTED}, s AS (SELECT u, year AS t, ln((y + 0.5) / (mu + 0.5)) AS x FROM expected), m AS (SELECT u, arg_max(x, t) AS level, regr_slope(x, t) AS slope, avg(x) AS flat FROM s WHERE t < 2001 GROUP BY ALL),
e AS (SELECT avg(pow(x - level - slope, 2)) AS linear, avg(pow(x - level - 0.5 * slope, 2)) AS damped, avg(pow(x - flat, 2)) AS flat FROM m JOIN s ON m.u = s.u WHERE t = 2001)
SELECT round(1 / linear / (1 / linear + 1 / damped + 1 / flat), 6) AS linear, round(1 / damped / (1 / linear + 1 / damped + 1 / flat), 6) AS damped, round(1 / flat / (1 / linear + 1 / damped + 1 / flat), 6) AS flat FROM e"""
)
def member_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = expected(spark, sf_dir).select("u", F.col("year").alias("t"), F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("x"))
    return mo.member_weights(s, 2001).select(r6("linear"), r6("damped"), r6("flat"))


@query(f"WITH {REC}, c AS (SELECT split_part(code, '|', 1) AS g, year, sum(wt) AS y FROM cells GROUP BY ALL), m AS (SELECT *, sum(y) OVER (PARTITION BY g) * sum(y) OVER (PARTITION BY year) / sum(y) OVER () AS mu FROM c) SELECT g, year, y::BIGINT AS y, round(mu, 5) AS mu, round(ln((y + 50) / (mu + 50)), 6) AS course FROM m")
def category_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).select(F.split_part("code", F.lit("|"), F.lit(1)).alias("g"), "year", F.col("wt").alias("y"))
    return mo.category_courses(rows).select("g", "year", "y", F.round("mu", 5).alias("mu"), r6("course"))


@query(
    f"""WITH {REC}, m AS (SELECT u, code, ln(mark) AS x FROM cells WHERE mark > 0), b AS (SELECT code, avg(x) AS m FROM m GROUP BY ALL), p AS (SELECT u, count(*) AS n, sum(x - b.m) AS d, sum((x - b.m) * (x - b.m)) AS dd FROM m JOIN b ON m.code = b.code GROUP BY ALL),
v AS (SELECT sum(dd - d * d / n) / (sum(n) - count(*)) AS v FROM p), t AS (SELECT greatest(0, avg(d / n * d / n - v / n)) AS tau FROM p, v) SELECT u, n::BIGINT AS n, round(d / n * tau / (tau + v / n), 6) AS location FROM p, v, t"""
)
def mark_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.log("mark")
    rows = governed(spark, sf_dir).where("mark > 0").groupBy("u", "code").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    return mo.mark_location(rows).select("u", "n", r6("location"))


@query(f"WITH {REC}, p AS (SELECT u, count(*) AS n, count(*) FILTER (status = 'R') AS k FROM cells GROUP BY ALL), t AS (SELECT sum(k) / sum(n) AS p FROM p), s AS (SELECT u, n, k, p, (k + 20 * p) / (n + 20) AS q FROM p, t) SELECT u, n::BIGINT AS n, k::BIGINT AS k, round(ln(q / (1 - q)) - ln(p / (1 - p)), 6) AS location FROM s")
def share_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).groupBy("u").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "R", 1)).alias("k"))
    return mo.share_location(rows).select("u", "n", "k", r6("location"))


@query(
    f"""WITH {EXPECTED}, sp AS (SELECT s_nationkey AS u, count(*)::DOUBLE AS s FROM supplier GROUP BY ALL), i AS (SELECT e.y, e.mu, coalesce(sp.s, 0.5) / avg(coalesce(sp.s, 0.5)) OVER () AS ix FROM expected e LEFT JOIN sp ON e.u = sp.u),
x AS (SELECT range / 4.0 AS exponent FROM range(5)), m AS (SELECT exponent::DOUBLE AS exponent, y, mu * pow(ix, exponent) AS m FROM i, x), l AS (SELECT *, m * sum(y) OVER (PARTITION BY exponent) / sum(m) OVER (PARTITION BY exponent) AS mm FROM m)
SELECT exponent, round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / mm) ELSE 0 END - (y - mm)), 3) AS deviance FROM l GROUP BY ALL"""
)
def supply_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.sources.records import table

    supply = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("u")).agg(F.count("*").cast("double").alias("s"))
    rows = expected(spark, sf_dir).join(supply, "u", "left").withColumn("s", F.coalesce("s", F.lit(0.5)))
    mean = rows.agg(F.avg("s").alias("_m"))
    rows = rows.crossJoin(mean).withColumn("index", F.col("s") / F.col("_m"))  # one row
    return mo.supply_exponent(rows, [0, 0.25, 0.5, 0.75, 1]).select("exponent", F.round("deviance", 3).alias("deviance"))
