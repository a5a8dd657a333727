"""Propagation, noise, facility effects and planted signals over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cellweave.operators import departures as de, error_control as ec, expectation as ex, noise as no, waves as wv
from cellweave.operators.ranking import running
from cellweave.queries.analysis import _P, _tests
from cellweave.queries.base import EXPECTED, REC, expected, governed, places, query
from cellweave.queries.readers import _MARKS, _marked
from cellweave.sources.records import table

r6 = lambda col, name=None: F.round(col, 6).alias(name or col)

_HITS = f"{EXPECTED}, hits AS (SELECT u, year, y > 1.1 * mu AS rejected FROM expected), onset AS (SELECT u, min(year) AS onset FROM hits WHERE rejected GROUP BY ALL)"


def _onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wv.onsets(expected(spark, sf_dir).select("u", "year", (F.col("y") > 1.1 * F.col("mu")).alias("rejected")))


@query(f"WITH {_HITS} SELECT u, onset::INT AS onset FROM onset")
def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _onsets(spark, sf_dir)


@query(f"WITH {_HITS}, b AS (SELECT e.u, sum(y) AS y, sum(mu) AS mu FROM expected e JOIN onset o ON e.u = o.u WHERE year < onset GROUP BY ALL) SELECT o.u, onset::INT AS onset, coalesce(b.y, 0) = 0 AND exp(-coalesce(mu, 0)) >= 0.5 AS absent FROM onset o LEFT JOIN b ON o.u = b.u")
def absent_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wv.absent_before(expected(spark, sf_dir), _onsets(spark, sf_dir))


#: Suppliers on a line, their balance: each with the 30 before and the 30 after it.
NEAR = 30


def _first_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers' first sales as onsets, and distances of each supplier to those of like balance."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("u")).agg(F.datediff(F.min("l_shipdate"), F.lit("1994-01-01").cast("date")).alias("onset"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("u"), F.col("s_acctbal").alias("at"))
    s = running(s, ["at", "u"], {"k": F.lit(1)})
    around = s.select(F.col("u").alias("source"), F.col("at").alias("from"), "k", F.explode(F.sequence(F.lit(-NEAR), F.lit(NEAR))).alias("by"))
    around = around.select("source", "from", (F.col("k") + F.col("by")).alias("k"))
    return first, around.join(s, "k").select("source", "u", F.abs(F.col("from") - F.col("at")).alias("d"))


@query()
def wave_of_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    onset, distance = _first_orders(spark, sf_dir)
    return wv.waves(onset, distance).select("wave", "source", r6("score"), "places", r6("rho"), r6("p"), "found")


@query(
    """WITH o AS (SELECT l_suppkey AS u, min(l_shipdate)::DATE - DATE '1994-01-01' AS onset FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS k FROM supplier),
d AS (SELECT a.s_suppkey AS source, b.s_suppkey AS u, abs(a.s_acctbal - b.s_acctbal) AS d FROM r a JOIN r b ON b.k BETWEEN a.k - 30 AND a.k + 30)
SELECT source, round(median(d / (o.onset - s.onset)), 6) AS speed FROM d JOIN o ON d.u = o.u JOIN o s ON d.source = s.u WHERE o.onset > s.onset GROUP BY ALL"""
)
def wave_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wv.speed(*_first_orders(spark, sf_dir)).select("source", r6("speed"))


_SCORES = f"""{EXPECTED}, r AS (SELECT u, year, (y - mu) / sqrt(mu + mu * mu / phi) AS r, year::DOUBLE AS t FROM expected), m AS (SELECT *, avg(r) OVER (PARTITION BY u) AS rm, avg(t) OVER (PARTITION BY u) AS tm FROM r),
sc AS (SELECT u, year, greatest(-3.5, least(3.5, r - rm - (t - tm) * sum((t - tm) * (r - rm)) OVER (PARTITION BY u) / sum((t - tm) * (t - tm)) OVER (PARTITION BY u))) AS e FROM m)"""


@query(f"WITH {_SCORES}, l AS (SELECT e, lag(e, 1) OVER w AS l1, lag(e, 2) OVER w AS l2 FROM sc WINDOW w AS (PARTITION BY u ORDER BY year)) SELECT 1 AS lag, round(sum(e * l1) / sum(e * e), 5) AS rho FROM l UNION ALL SELECT 2, round(sum(e * l2) / sum(e * e), 5) FROM l")
def noise_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return no.autocorrelation(no.winsorised_scores(expected(spark, sf_dir)), 2).select("lag", F.round("rho", 5).alias("rho"))


@query()
def noise_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return no.kappa(ex.surprise(expected(spark, sf_dir))).select(r6("kappa"))


_FAC = f"""{_MARKS}, b AS (SELECT code, avg(lm) AS base FROM marked WHERE mark_reason IS NULL GROUP BY ALL),
f AS (SELECT facility, count(*) AS n, sum(lm - base) AS sr, sum((lm - base) * (lm - base)) AS sr2 FROM marked JOIN b ON marked.code = b.code WHERE mark_reason IS NULL GROUP BY ALL)"""


@query(
    f"""WITH {_FAC}, p AS (SELECT sum(sr2 - sr * sr / n) / sum(n - 1) AS s2, sum(sr) / sum(n) AS m, sum(n) AS nn, sum(n::DOUBLE * n) AS n2, count(*) AS k FROM f),
q AS (SELECT sum(n * (sr / n - m) * (sr / n - m)) / any_value(s2) AS q FROM f, p), t AS (SELECT greatest(0, (q - (k - 1)) / ((nn - n2 / nn) / s2)) AS tau2 FROM p, q)
SELECT facility, n::BIGINT AS n, round((sr / n - m) * tau2 / (tau2 + s2 / n), 6) AS effect FROM f, p, t"""
)
def facility_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir).where("mark_reason is null")
    base = rows.groupBy("code").agg(F.avg("log_mark").alias("base"))
    r = F.col("log_mark") - F.col("base")
    sums = rows.join(base, "code").groupBy("facility").agg(F.count("*").alias("n"), F.sum(r).alias("sr"), F.sum(r * r).alias("sr2"))
    return no.facility_effects(sums).select("facility", "n", r6("effect"))


def _scattered(total: str) -> str:
    return f"((((({total})::BIGINT % 2147483648 * 2654435761 % 4294967296) >> 9) * 1103515245 + 12345) % 2147483648 / 2147483648.0)"


@query(
    f"""WITH {REC}, c AS (SELECT u, year, count(*) AS y FROM cells GROUP BY ALL), e AS (SELECT u, year, unnest(range(1, y + 1)) AS i FROM c), a AS (SELECT u, year, sum(({_scattered("u::BIGINT * 73856093 + year::BIGINT * 19349663 + i::BIGINT * 83492791")} < 0.5)::INT) AS a FROM e GROUP BY ALL)
SELECT c.u, c.year, y::BIGINT AS y, a::BIGINT AS a, (y - a)::BIGINT AS b FROM c JOIN a ON c.u = a.u AND c.year = a.year"""
)
def event_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = governed(spark, sf_dir).groupBy("u", "year").agg(F.count("*").alias("y"))
    return no.event_sides(cells, 0.5, keys=("u", "year")).select("u", "year", "y", "a", "b")


@query(f"WITH {EXPECTED} SELECT u, year, (CASE WHEN u % 5 = 0 THEN round(y * CASE WHEN year >= 1999 THEN 1.5 ELSE 1.0 END) ELSE y END)::BIGINT AS y FROM expected")
def planted_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return no.planted(expected(spark, sf_dir), F.col("u") % 5 == 0, 1.5, shape="step", first=1999).select("u", "year", "y")


@query(
    f"""WITH {EXPECTED}, rg AS (SELECT region, row_number() OVER (ORDER BY {_scattered("region::BIGINT * 73856093")}, region) % 2 AS half FROM (SELECT DISTINCT region FROM places))
SELECT CASE WHEN rg.region = 0 THEN 'own' ELSE concat('half ', half) END AS side, count(DISTINCT expected.u)::BIGINT AS places, sum(y)::BIGINT AS y, round(sum(mu), 6) AS mu, round((sum(y) + 0.5) / (sum(mu) + 0.5), 6) AS ratio FROM expected JOIN places ON expected.u = places.u JOIN rg ON places.region = rg.region GROUP BY ALL"""
)
def jurisdiction_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expected(spark, sf_dir).join(places(spark, sf_dir), "u")
    return no.jurisdictions(rows, place="u", state="region", own=F.col("region") == 0).select("side", "places", "y", r6("mu"), r6("ratio"))


@query(
    f"""WITH {EXPECTED}, s AS (SELECT sum(mu) AS w, sum(mu * n) AS wx, sum(mu * ln((y + 0.5) / (mu + 0.5))) AS wr, sum(mu * n * ln((y + 0.5) / (mu + 0.5))) AS wxr, sum(mu * n * n) AS wxx FROM expected),
b AS (SELECT wx / w AS m, (wxr - wx * wr / w) / (wxx - wx * wx / w) AS b, wr / w AS a FROM s), f AS (SELECT y, mu, mu * exp(a + b * (n - m)) AS fitted, b FROM expected, b)
SELECT round(1 - sum(CASE WHEN y > 0 THEN y * ln(y / fitted) ELSE 0 END - (y - fitted)) / sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu)), 5) AS absorbed, round(any_value(b), 5) AS slope FROM f"""
)
def explained_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    return no.explained_away(expected(spark, sf_dir), "n").select(F.round("absorbed", 5).alias("absorbed"), F.round("slope", 5).alias("slope"))


@query(
    f"""WITH {_P}, un AS (SELECT DISTINCT u, region FROM tests), hv AS (SELECT u, row_number() OVER (PARTITION BY region ORDER BY {_scattered("u::BIGINT * 73856093")}, u) % 2 AS half FROM un),
r AS (SELECT id, half, p, row_number() OVER (PARTITION BY half ORDER BY p, id) AS k, count(*) OVER (PARTITION BY half) AS m FROM tests JOIN hv ON tests.u = hv.u)
SELECT id, half::INT AS half, round(least(1.0, min(p * m / k) OVER (PARTITION BY half ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM r"""
)
def replicated_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's places halved, and the tests of each half adjusted on their own."""
    halved = ec.halves(_tests(spark, sf_dir), unit="u", within="region")
    return ec.adjusted(halved, by=("half",)).select("id", "half", r6("q_value"))


#: Regions' months against an even year.
_SEASON = f"""{REC}, mo AS (SELECT region AS u, year, month, sum(wt) AS y FROM cells JOIN places ON cells.u = places.u GROUP BY ALL), mm AS (SELECT *, sum(y) OVER (PARTITION BY u, year) / 12.0 AS mu FROM mo),
h AS (SELECT u, year, round(sum(ln((y + 0.5) / (mu + 0.5)) * sin(2 * pi() * (month - 1) / 12)) / 6, 6) AS s, round(sum(ln((y + 0.5) / (mu + 0.5)) * cos(2 * pi() * (month - 1) / 12)) / 6, 6) AS c FROM mm GROUP BY ALL HAVING count(*) = 12)"""


def _regional_harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).join(places(spark, sf_dir), "u").groupBy(F.col("region").alias("u"), "year", "month").agg(F.sum("wt").alias("y"))
    rows = rows.withColumn("mu", F.sum("y").over(W.partitionBy("u", "year")) / 12.0)
    return de.harmonics(rows).select("u", "year", r6("sin"), r6("cos"))


@query(
    f"""WITH {_SEASON} SELECT u, count(*)::BIGINT AS years, round(sqrt(avg(s) * avg(s) + avg(c) * avg(c)), 6) AS amplitude, round(atan2(avg(s), avg(c)) * 6 / pi(), 4) AS phase,
round(count(*) * (avg(s) * avg(s) + avg(c) * avg(c)) / (var_samp(s) + var_samp(c)), 5) AS f FROM h GROUP BY ALL HAVING count(*) >= 4"""
)
def season_departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = de.season_departure(_regional_harmonics(spark, sf_dir))
    return out.select("u", "years", r6("amplitude"), F.round("phase", 4).alias("phase"), F.round("f", 5).alias("f"))


#: The tail of F on 2 and m degrees of freedom is (1 + 2 f / m) ** (-m / 2).
@query(
    f"""WITH {_SEASON}, t AS (SELECT u, count(*) AS k, count(*) * (avg(s) * avg(s) + avg(c) * avg(c)) / (var_samp(s) + var_samp(c)) AS f FROM h GROUP BY ALL HAVING count(*) >= 4), p AS (SELECT u, pow(1 + f / (k - 1), 1 - k) AS p FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY p, u) AS k, count(*) OVER () AS m FROM p), l AS (SELECT max(k) AS last FROM r WHERE p <= 0.1 * k / m) SELECT u, round(p, 6) AS p, coalesce(k <= last, false) AS rejected FROM r, l"""
)
def season_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = de.season_departure(_regional_harmonics(spark, sf_dir)).withColumn("id", F.col("u"))
    return ec.bh(out, 0.1).select("u", r6("p"), "rejected")
