"""Shares, contexts, links, facts, registers and surveys over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellweave.operators import departures as d, error_control as ec, expectation as ex, interpret as it, reading as rd
from cellweave.queries.analysis import _FIELDS, _STEP, _TREND, _bh_sql, _fields
from cellweave.queries.base import EXPECTED, REC, expected, governed, places, query
from cellweave.sources.records import table
from cellweave.sources.scratch import staged

r6 = lambda col, name=None: F.round(col, 6).alias(name or col)


@query(
    f"""WITH {REC}, s AS (SELECT u, year, count(*) FILTER (status <> 'R') / count(*) AS share FROM cells WHERE year % 3 <> 0 GROUP BY ALL), g AS (SELECT DISTINCT s.u, t.range::INT AS year FROM s, range(1995, 2002) t), f AS (SELECT g.u, g.year, s.share FROM g LEFT JOIN s ON g.u = s.u AND g.year = s.year),
n AS (SELECT *, max(CASE WHEN share IS NOT NULL THEN year END) OVER (PARTITION BY u ORDER BY year) AS b, min(CASE WHEN share IS NOT NULL THEN year END) OVER (PARTITION BY u ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a, avg(share) OVER (PARTITION BY u) AS m FROM f)
SELECT u, year, round(coalesce(share, m), 6) AS share, round(CASE WHEN share IS NULL THEN 0.02 * sqrt(CASE WHEN b IS NULL THEN a - year WHEN a IS NULL THEN year - b ELSE least(year - b, a - year) END) ELSE 0 END, 6) AS sd, share IS NULL AS extended FROM n"""
)
def filled_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = governed(spark, sf_dir).where("year % 3 <> 0").groupBy("u", "year").agg((F.count(F.when(F.col("status") != "R", 1)) / F.count("*")).alias("share"))
    return rd.filled_share(shares, list(range(1995, 2002))).select("u", "year", r6("share"), r6("sd"), "extended")


@query("WITH o AS (SELECT c_nationkey AS u, year(o_orderdate) AS year, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1997 AND 1999) SELECT n_nationkey AS u, round(sum(v) / count(v), 4) AS value FROM nation LEFT JOIN o ON n_nationkey = o.u GROUP BY ALL")
def context_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("u"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("u"))
    return rd.context_value(o, o.withColumn("value", F.lit(1.0)), n, F.col("year").between(1997, 1999)).select("u", F.round("value", 4).alias("value"))


@query("WITH e AS (SELECT l_orderkey AS id, s_nationkey AS u, year(l_shipdate) AS year, p_type AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey), l AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F') SELECT e.u, left(code, 3) AS code, count(*)::BIGINT AS y, count(l.id)::BIGINT AS k FROM e LEFT JOIN l ON e.id = l.id WHERE year = 1998 GROUP BY ALL")
def source_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    e = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    e = e.select(F.col("l_orderkey").alias("id"), F.col("s_nationkey").alias("u"), F.year("l_shipdate").alias("year"), F.col("p_type").alias("code"))
    return rd.source_year(e, t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), 1998)


@query("WITH r AS (SELECT l_orderkey AS l, l_partkey AS r, l_returnflag AS run, 1 - l_discount AS p FROM lineitem) SELECT l, r, round(max(p), 6) AS p_match, count(DISTINCT run)::BIGINT AS runs FROM r GROUP BY ALL")
def covering_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("l"), F.col("l_partkey").alias("r"), F.col("l_returnflag").alias("run"), (1 - F.col("l_discount")).alias("p_match"))
    return rd.covering_pairs(runs).select("l", "r", r6("p_match"), "runs")


@query("WITH f AS (SELECT l_suppkey AS id, l_shipdate AS known, max(l_extendedprice) AS size FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-30' GROUP BY ALL) SELECT id, arg_max(round(size, 2), known) AS size FROM f GROUP BY ALL")
def facts_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_shipdate").alias("at")).agg(F.max("l_extendedprice").alias("size"))
    return rd.facts_at(facts, F.lit("1998-06-30").cast("timestamp_ntz")).select("id", F.round("size", 2).alias("size"))


@query(f"WITH {REC} SELECT code, min(age)::INT AS least_age, max(age)::INT AS most_age, list_sort(list(DISTINCT sex)) AS sexes FROM cells GROUP BY ALL")
def code_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.code_attributes(governed(spark, sf_dir))


@query(f"WITH {REC}, l AS (SELECT u, year, wt, unnest(CASE WHEN starts_with(code, 'STANDARD') AND code = 'STANDARD|Brand#3' THEN ['plain', 'third'] WHEN starts_with(code, 'STANDARD') OR starts_with(code, 'SMALL') THEN ['plain'] WHEN code = 'ECONOMY|Brand#3' THEN ['third'] ELSE [] END) AS concept FROM cells) SELECT concept, u, year, sum(wt)::BIGINT AS y FROM l GROUP BY ALL")
def list_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = spark.createDataFrame([("plain", "STANDARD%"), ("plain", "SMALL%"), ("third", "STANDARD|Brand#3"), ("third", "ECONOMY|Brand#3")], "concept string, code string")
    cells = governed(spark, sf_dir).groupBy("u", "year", "code").agg(F.sum("wt").alias("y"))
    return rd.list_fields(cells, concepts)


@query("WITH m AS (SELECT o_orderpriority AS before, l_returnflag AS after, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT before, after, round(n / sum(n) OVER (PARTITION BY before), 6) AS share FROM m QUALIFY n / sum(n) OVER (PARTITION BY before) >= 0.333")
def exchanging_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    moves = rows.groupBy(F.col("o_orderpriority").alias("before"), F.col("l_returnflag").alias("after")).agg(F.count("*").alias("n"))
    return rd.exchanging_pools(moves, least=0.333).select("before", "after", r6("share"))


@query(f"WITH {REC}, m AS (SELECT year, avg((sex IS NULL)::INT) AS sex, avg((age IS NULL)::INT) AS age, avg((code IS NULL OR trim(code) = '')::INT) AS code FROM rec GROUP BY ALL) SELECT year, 'sex' AS \"column\", round(sex, 6) AS missing FROM m UNION ALL SELECT year, 'age', round(age, 6) FROM m UNION ALL SELECT year, 'code', round(code, 6) FROM m")
def missing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.queries.base import records

    return rd.missing_shares(records(spark, sf_dir), ["sex", "age", "code"]).select("year", "column", r6("missing"))


@query("WITH v AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL) SELECT value, round(n / (SELECT sum(n) FROM v), 6) AS share FROM v QUALIFY row_number() OVER (ORDER BY n DESC, value DESC) > 1")
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.value_shares(table(spark, sf_dir, "orders"), "o_orderpriority").select("value", r6("share"))


@query(f"WITH {REC}, v AS (SELECT u, status AS value, sum(wt) AS observed FROM cells GROUP BY ALL), e AS (SELECT *, sum(observed) OVER (PARTITION BY u) * sum(observed) OVER (PARTITION BY value) / sum(observed) OVER () AS expected FROM v) SELECT u, value, observed::BIGINT AS observed, round(expected, 5) AS expected, round((observed + 0.5) / (expected + 0.5), 6) AS ratio FROM e")
def by_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).select("u", F.col("status").alias("value"), F.col("wt").alias("y"))
    return rd.by_value(rows, "value").select("u", "value", "observed", F.round("expected", 5).alias("expected"), r6("ratio"))


@query(f"WITH {_FIELDS} SELECT field, sum(y)::BIGINT AS y, round(sum(mu), 5) AS mu, round((sum(y) + 0.5) / (sum(mu) + 0.5), 6) AS ratio FROM fields WHERE u = 7 OR year = 1999 GROUP BY ALL")
def related_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.related_fields(_fields(spark, sf_dir), (F.col("u") == 7) | (F.col("year") == 1999)).select("field", "y", F.round("mu", 5).alias("mu"), r6("ratio"))


@query(
    f"""WITH {EXPECTED}, loci AS (SELECT * FROM (VALUES ('a', 2, 1997, 1999), ('b', 7, 1996, 2000), ('c', 3, 2000, 2001)) v(id, u, first, last)), s AS (SELECT id, sum(y) AS y, sum(mu) AS mu, sum(mu + mu * mu / phi) AS v FROM expected JOIN loci ON expected.u = loci.u AND year BETWEEN first AND last GROUP BY ALL)
SELECT id, y::BIGINT AS y, round(mu, 5) AS mu, round((y + 0.5) / (mu + 0.5), 6) AS ratio, round((pow(y / mu, 1 / 3.0) - (1 - v / (mu * mu) / 9)) / sqrt(v / (mu * mu) / 9), 5) AS z FROM s"""
)
def declared_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    loci = spark.createDataFrame([("a", 2, 1997, 1999), ("b", 7, 1996, 2000), ("c", 3, 2000, 2001)], "id string, u int, first int, last int")
    return rd.declared_tests(expected(spark, sf_dir), loci).select("id", "y", F.round("mu", 5).alias("mu"), r6("ratio"), F.round("z", 5).alias("z"))


#: A register of suppliers: class by the rules of triage, tier by line numbers, rank by size.
_REG = """reg AS (SELECT l_suppkey AS id, any_value(s_nationkey) AS place, count(*) AS events, year(min(l_shipdate))::INT AS first, year(max(l_shipdate))::INT AS last, (max(l_linenumber) % 4)::INT AS tier,
CASE WHEN avg(l_discount) > 0.0505 THEN 'signal' WHEN avg(l_quantity) > 25.6 THEN 'recording' ELSE 'noise' END AS class, round(avg(l_discount) * count(*), 6) AS rank FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _mean_above(name: str, bound: float) -> Column:
    """Whether a column's mean exceeds ``bound``. Near it sums of whole billionths decide, which are the same in every order
    of the rows; a mean in double precision that equals the bound falls on either side of it."""
    mean, whole = F.avg(name), F.sum(F.rint(F.col(name) * 1e9))
    return F.when(F.abs(mean - bound) < 1e-9, whole > F.count(name) * float(round(bound * 1e9))).otherwise(mean > bound)


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    cls = F.when(_mean_above("l_discount", 0.0505), "signal").when(_mean_above("l_quantity", 25.6), "recording").otherwise("noise")
    return rows.groupBy(F.col("l_suppkey").alias("id")).agg(F.first("s_nationkey").alias("place"), F.count("*").alias("events"), F.year(F.min("l_shipdate")).alias("first"), F.year(F.max("l_shipdate")).alias("last"), (F.max("l_linenumber") % 4).cast("int").alias("tier"), cls.alias("class"), F.round(F.avg("l_discount") * F.count("*"), 6).alias("rank"))


@query(f"WITH {_REG} SELECT id, place, class, tier, rank FROM reg WHERE class = 'signal' AND tier >= 1 AND last >= 1998")
def find_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.find_leads(_register(spark, sf_dir), cls="signal", tier=1, first=1998).select("id", "place", "class", "tier", "rank")


@query(f"WITH {_REG}, k AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY rank DESC, id) AS k, count(*) OVER (PARTITION BY place) - 1 AS siblings FROM reg) SELECT a.id, a.class, a.siblings::BIGINT AS siblings, b.id AS sibling FROM k a LEFT JOIN k b ON a.place = b.place AND b.k = CASE WHEN a.k = 1 THEN 2 ELSE 1 END")
def explain_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.with_siblings(_register(spark, sf_dir)).select("id", "class", "siblings", "sibling")


@query(f"WITH {_REG} SELECT class, n_regionkey AS region, count(*)::BIGINT AS leads, count(*) FILTER (tier >= 1)::BIGINT AS replicated FROM reg JOIN nation ON place = n_nationkey GROUP BY ALL")
def triage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("region"))
    return rd.class_counts(_register(spark, sf_dir).join(n, "place"), "region")


@query(f"WITH {_REG} SELECT id, concat('| ', id, ' | ', place, ' | ', class, ' | ', first, '-', last, ' |') AS line FROM reg ORDER BY rank DESC, id LIMIT 20")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.report_lines(_register(spark, sf_dir), 20)


_FLAGS = f"WITH {_STEP}, {_TREND.removeprefix(EXPECTED + ', ')}, x AS (SELECT u, max((y + 0.5) / (mu + 0.5)) > 1.15 AS excess FROM expected GROUP BY ALL), fl AS (SELECT x.u, excess, 0.05 * bf / (0.05 * bf + 0.95) > 0.5 AS step, abs(beta / sd) > 2 AS trend FROM x JOIN g ON x.u = g.u JOIN trend ON x.u = trend.u)"


@query(f"{_FLAGS} SELECT concat_ws('+', CASE WHEN excess THEN 'excess' END, CASE WHEN step THEN 'step' END, CASE WHEN trend THEN 'trend' END) AS methods, count(*)::BIGINT AS units FROM fl GROUP BY ALL")
def method_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = expected(spark, sf_dir)
    x = e.groupBy("u").agg((F.max((F.col("y") + 0.5) / (F.col("mu") + 0.5)) > 1.15).alias("excess"))
    s = d.steps(e).select("u", (F.col("posterior") > 0.5).alias("step"))
    t = d.trends(e).select("u", (F.abs(F.col("beta") / F.col("sd")) > 2).alias("trend"))
    return rd.agreement(x.join(s, "u").join(t, "u"), ["excess", "step", "trend"])


#: Every field and place: the half-years' sums over all years against the field's and the place's own totals; chi-square on
#: 2 degrees of freedom, phi by moments over all.
_SURVEY = f"""{REC}, sy AS (SELECT split_part(code, '|', 1) AS field, u, (month > 6)::INT AS half, sum(wt) AS y FROM cells GROUP BY ALL), sm AS (SELECT *, sum(y) OVER (PARTITION BY field, half) * sum(y) OVER (PARTITION BY u, half) / sum(y) OVER (PARTITION BY half) AS mu FROM sy),
sp AS (SELECT CASE WHEN sum((y - mu) * (y - mu) - mu) > 0 THEN greatest(sum(mu * mu) / sum((y - mu) * (y - mu) - mu), 0.01) ELSE 1e9 END AS phi FROM sm), tests AS (SELECT concat(field, ':', u) AS id, field, u, round(exp(-sum((y - mu) * (y - mu) / (mu + mu * mu / phi)) / 2), 9) AS p FROM sm, sp GROUP BY ALL)"""


def _survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    y = staged(governed(spark, sf_dir).groupBy(F.split_part("code", F.lit("|"), F.lit(1)).alias("field"), "u", (F.col("month") > 6).cast("int").alias("half")).agg(F.sum("wt").alias("y")), "survey")
    rows = staged(y.withColumn("mu", F.sum("y").over(W.partitionBy("field", "half")) * F.sum("y").over(W.partitionBy("u", "half")) / F.sum("y").over(W.partitionBy("half"))), "survey")
    rows = rows.crossJoin(ex.dispersion(rows))  # one row
    x = (F.col("y") - F.col("mu")) ** 2 / (F.col("mu") + F.col("mu") ** 2 / F.col("phi"))
    return rows.groupBy("field", "u").agg(F.round(F.exp(-F.sum(x) / 2), 9).alias("p")).withColumn("id", F.concat_ws(":", "field", F.col("u").cast("string")))


@query(
    f"""WITH {_SURVEY}, rs AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY p, id) AS k, count(*) OVER (PARTITION BY field) AS m FROM tests), fam AS (SELECT field, min(p * m / k) AS fp FROM rs GROUP BY ALL), fr AS (SELECT *, row_number() OVER (ORDER BY fp, field) AS k, count(*) OVER () AS m FROM fam), fl AS (SELECT coalesce(max(k), 0) AS last FROM fr WHERE fp <= 0.4 * k / m),
sel AS (SELECT field, k <= last AS chosen, 0.4 * last / m AS q FROM fr, fl), lim AS (SELECT rs.field, max(CASE WHEN p <= q * k / m THEN k END) AS last FROM rs JOIN sel ON rs.field = sel.field GROUP BY ALL)
SELECT id, p, coalesce(chosen AND k <= last, false) AS rejected FROM rs JOIN sel ON rs.field = sel.field JOIN lim ON rs.field = lim.field"""
)
def survey_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ec.bogomolov(_survey(spark, sf_dir), 0.4, family="field").select("id", "p", "rejected")


@query("WITH w AS (SELECT ts::DATE - dayofweek(ts::DATE)::INT AS week_start, ts::DATE AS day FROM events), c AS (SELECT week_start FROM w WHERE week_start + 6 < (SELECT max(day) FROM w)) SELECT week_start, count(*)::BIGINT AS y FROM c WHERE week_start > (SELECT max(week_start) FROM c) - 21 GROUP BY ALL")
def closed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.closed_weeks(table(spark, sf_dir, "events"), 3)


@query(f"WITH {EXPECTED}, h AS (SELECT u, y, mu, (year > (SELECT (min(year) + max(year)) / 2 FROM expected))::INT AS half FROM expected), r AS (SELECT u, ln((coalesce(sum(y) FILTER (half = 0), 0) + 0.5) / (coalesce(sum(mu) FILTER (half = 0), 0) + 0.5)) AS early, ln((coalesce(sum(y) FILTER (half = 1), 0) + 0.5) / (coalesce(sum(mu) FILTER (half = 1), 0) + 0.5)) AS late FROM h GROUP BY ALL) SELECT u, round(early, 6) AS early, round(late, 6) AS late, sign(early) = sign(late) AS agree FROM r")
def temporal_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.temporal_halves(expected(spark, sf_dir), "u").select("u", r6("early"), r6("late"), "agree")


@query(f"WITH {_FIELDS}, x AS (SELECT field, u, year, ln((y + 0.5) / (mu + 0.5)) AS x FROM fields) SELECT lag::INT AS lag, round(corr(a.x, b.x), 6) AS rho, count(*)::BIGINT AS n FROM x a JOIN (SELECT range AS lag FROM range(3)) l ON true JOIN x b ON a.u = b.u AND a.year = b.year + lag WHERE a.field = 'STANDARD' AND b.field = 'SMALL' GROUP BY ALL")
def compare_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _fields(spark, sf_dir).select("field", "u", "year", F.log((F.col("y") + 0.5) / (F.col("mu") + 0.5)).alias("x"))
    return rd.lagged_pair(staged(x, "pair"), "STANDARD", "SMALL", 2).select("lag", r6("rho"), "n")


@query("WITH o AS (SELECT o_custkey AS id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS verdict FROM orders GROUP BY ALL) SELECT c_custkey AS id, coalesce(verdict, 'open') AS verdict FROM customer LEFT JOIN o ON c_custkey = o.id")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lead with its latest verdict, open where there is none."""
    given = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("verdict"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    leads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return leads.join(it.current(given).select("id", "verdict"), "id", "left").select("id", F.coalesce("verdict", F.lit("open")).alias("verdict"))
