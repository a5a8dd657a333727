"""Surveillance, persons, and the reading of findings over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cellweave.operators import counts as c, graphs, interpret as it, persons as pe, surveillance as sv
from cellweave.plans import study
from cellweave.queries.base import EXPECTED, REC, expected, governed, places, query, records
from cellweave.queries.readers import _DELAY
from cellweave.sources.records import table
from cellweave.streaming import weekly as st

r6 = lambda col, name=None: F.round(col, 6).alias(name or col)


def _delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.delays(records(spark, sf_dir), "date", "reported")[0].withColumn("delay", F.floor(F.col("delay") / 13).cast("int"))


_SHARES = f"""{_DELAY}, t AS (SELECT u, (d // 7 // 13)::INT AS delay, count(*) AS c FROM late WHERE d >= 0 AND d // 7 // 13 BETWEEN 0 AND 8 GROUP BY ALL),
nat AS (SELECT delay, sum(c) / (SELECT sum(c) FROM t) AS nat FROM t GROUP BY ALL), tot AS (SELECT u, sum(c) AS tot FROM t GROUP BY ALL),
g AS (SELECT tot.u, r.range::INT AS delay, tot, coalesce(c, 0) AS c, coalesce(nat, 0) AS nat FROM tot CROSS JOIN range(9) r LEFT JOIN t ON t.u = tot.u AND t.delay = r.range LEFT JOIN nat ON nat.delay = r.range),
m AS (SELECT sum((c / tot - nat) * (c / tot - nat)) AS v, sum(nat * (1 - nat)) AS s, sum(nat * (1 - nat) / tot) AS e FROM g WHERE tot >= 20),
a AS (SELECT greatest(CASE WHEN v > e THEN least(1e6, (s - v) / (v - e)) ELSE 1e6 END, 0) AS a FROM m)"""


@query(f"WITH {_SHARES} SELECT u, delay, round((c + a * nat) / (tot + a), 6) AS share FROM g, a")
def delay_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.delay_shares(_delays(spark, sf_dir), most=8).select("u", "delay", r6("share"))


#: What is known at the end of 2000 of each place and year: records reported by then, the share of the place's delays that
#: have passed since the middle of the year, and the mean of the years to 1998.
_NOW = f"""{_SHARES}, cum AS (SELECT u, delay, sum((c + a * nat) / (tot + a)) OVER (PARTITION BY u ORDER BY delay) AS f FROM g, a), rep AS (SELECT u, year, reported::DATE AS reported FROM rec WHERE reported::DATE >= date AND (reported::DATE - date) // 7 // 13 <= 8 AND year <= 2000),
was AS (SELECT u, count(*) / 4.0 AS mu FROM rep WHERE year BETWEEN 1995 AND 1998 GROUP BY ALL), kn AS (SELECT u, year, count(*) FILTER (reported <= DATE '2000-12-31') AS y FROM rep WHERE year >= 1999 GROUP BY ALL),
now AS (SELECT kn.u, year, y, coalesce(cum.f, 1) AS f, mu, 20.0 AS phi FROM kn JOIN was ON kn.u = was.u LEFT JOIN cum ON cum.u = kn.u AND cum.delay = (DATE '2000-12-31' - make_date(year, 7, 1)) // 91)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit("2000-12-31").cast("date")
    shares = sv.delay_shares(_delays(spark, sf_dir), most=8).select("u", F.col("delay").alias("_q"), F.col("cumulative").alias("f"))
    days = F.datediff("reported", "date")
    rows = records(spark, sf_dir).where((days >= 0) & (F.floor(F.floor(days / 7) / 13) <= 8) & (F.col("year") <= 2000))
    was = rows.where("year between 1995 and 1998").groupBy("u").agg((F.count("*") / 4.0).alias("mu"))
    known = rows.where("year >= 1999").groupBy("u", "year").agg(F.count(F.when(F.to_date("reported") <= end, 1)).alias("y"))
    passed = F.floor(F.datediff(end, F.make_date("year", F.lit(7), F.lit(1))) / 91).cast("int")
    return known.join(was, "u").withColumn("_q", passed).join(shares, ["u", "_q"], "left").select("u", "year", "y", F.coalesce("f", F.lit(1.0)).alias("f"), "mu", F.lit(20.0).alias("phi"))


@query(f"WITH {_NOW} SELECT u, year, y::BIGINT AS y, round(y + (phi + y) * (1 - f) / (phi / mu + f), 6) AS eventual FROM now")
def nowcast_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.nowcast(_known(spark, sf_dir)).select("u", "year", "y", r6("eventual"))


@query()
def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.alarms(_known(spark, sf_dir)).select("u", "year", "threshold", r6("probability"), "alarm")


@query(
    """WITH w AS (SELECT event_type, ts::DATE - dayofweek(ts::DATE)::INT AS week_start, count(*)::BIGINT AS y FROM events GROUP BY ALL), m AS (SELECT max(ts) - INTERVAL 14 DAY AS mark FROM events)
SELECT event_type, week_start, y FROM w, m WHERE week_start + INTERVAL 7 DAY <= mark"""
)
def weekly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that a stream over all events closes: those whose end is past the watermark of the last batch."""
    from cellweave.sources.scratch import staged

    given = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder = staged(given, "events").inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(given.schema).parquet(folder)
    return st.drained(st.weekly(stream), f"{folder}-weekly").select("event_type", "week_start", "y")


@query(
    f"""WITH {REC}, a AS (SELECT u, (age // 10)::INT AS g, count(*) FILTER (year = 1996)::DOUBLE AS n0, coalesce(sum(wt) FILTER (year = 1996), 0)::DOUBLE AS y0, count(*) FILTER (year = 2000)::DOUBLE AS n1, coalesce(sum(wt) FILTER (year = 2000), 0)::DOUBLE AS y1 FROM cells GROUP BY ALL)
SELECT round(sum(y1 - y0), 4) AS change FROM a"""
)
def decomposition_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.decomposition(_two_periods(spark, sf_dir)).select(F.round(F.col("size") + F.col("place") + F.col("composition") + F.col("risk"), 4).alias("change"))


def _two_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governed(spark, sf_dir).withColumn("g", F.expr("cast(age div 10 as int)"))
    at = lambda y: F.col("year") == y
    agg = {}
    for k, y in (("0", 1996), ("1", 2000)):
        agg[f"n{k}"] = F.count(F.when(at(y), 1)).cast("double")
        agg[f"y{k}"] = F.coalesce(F.sum(F.when(at(y), F.col("wt"))), F.lit(0)).cast("double")
    return rows.groupBy("u", "g").agg(*[v.alias(k) for k, v in agg.items()])


def _shapley(x: str) -> str:
    """SQL of one factor's mean change over all orders in which the four factors change."""
    others = [k for k in ("nn", "s", "c", "r") if k != x]
    terms = []
    for changed in range(8):
        now = [bool(changed >> i & 1) for i in range(3)]
        weight = "0.25" if sum(now) in (0, 3) else "(1 / 12.0)"
        rest = " * ".join(f"{k}{int(f)}" for k, f in zip(others, now))
        terms.append(f"{weight} * {rest} * ({x}1 - {x}0)")
    return "round(sum(" + " + ".join(terms) + "), 4)"


@query(
    f"""WITH {REC}, w AS (SELECT u, (age // 10)::INT AS g, count(*) FILTER (year = 1996)::DOUBLE AS n0, coalesce(sum(wt) FILTER (year = 1996), 0)::DOUBLE AS y0, count(*) FILTER (year = 2000)::DOUBLE AS n1, coalesce(sum(wt) FILTER (year = 2000), 0)::DOUBLE AS y1 FROM cells GROUP BY ALL),
f AS (SELECT *, sum(n0) OVER () AS nn0, sum(n1) OVER () AS nn1, sum(n0) OVER p / sum(n0) OVER () AS s0, sum(n1) OVER p / sum(n1) OVER () AS s1, CASE WHEN sum(n0) OVER p > 0 THEN n0 / sum(n0) OVER p ELSE 0 END AS c0, CASE WHEN sum(n1) OVER p > 0 THEN n1 / sum(n1) OVER p ELSE 0 END AS c1,
CASE WHEN n0 > 0 THEN y0 / n0 ELSE 0 END AS r0, CASE WHEN n1 > 0 THEN y1 / n1 ELSE 0 END AS r1 FROM w WINDOW p AS (PARTITION BY u)) SELECT {_shapley("nn")} AS size, {_shapley("s")} AS place, {_shapley("c")} AS composition, {_shapley("r")} AS risk, round(sum(y1 - y0), 4) AS change FROM f"""
)
def decomposition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.decomposition(_two_periods(spark, sf_dir)).select(*[F.round(x, 4).alias(x) for x in ("size", "place", "composition", "risk", "change")])


@query(f"WITH {EXPECTED} SELECT u, round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu)), 5) AS deviance FROM expected GROUP BY ALL")
def deviance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.deviance(expected(spark, sf_dir), by=("u",)).select("u", F.round("deviance", 5).alias("deviance"))


@query()
def honest_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.honest_size(expected(spark, sf_dir)).select("u", "year", r6("size"), r6("low"), r6("high"))


_RELEVEL = f"""{EXPECTED}, o AS (SELECT e.u, e.year, mu, region, CASE WHEN e.u % 7 = 0 THEN 0 ELSE 1 END AS out, y FROM expected e JOIN places USING (u)),
rl AS (SELECT u, year, mu, sum(out * y) OVER s AS sy, sum(out * mu) OVER s AS sm, sum(out * y) OVER n AS ny, sum(out * mu) OVER n AS nm FROM o WINDOW s AS (PARTITION BY region, year), n AS (PARTITION BY year))"""


@query(f"WITH {_RELEVEL} SELECT u, year, round(CASE WHEN sm >= 100 THEN sy / sm WHEN nm > 0 THEN ny / nm ELSE 1 END, 6) AS level FROM rl")
def relevel_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expected(spark, sf_dir).join(places(spark, sf_dir), "u")
    return it.relevel_outside(rows, F.col("u") % 7 == 0, state="region").select("u", "year", r6("level"))


@query(
    """WITH s AS (SELECT l_suppkey, count(*) AS events, avg(l_quantity) / 25.5 AS ratio, max(l_discount) AS share, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY ALL)
SELECT l_suppkey AS id, CASE WHEN events < 10 THEN 'noise' WHEN ratio < 1.5 AND ratio > 1 / 1.5 AND events < 30 THEN 'noise' WHEN share >= 0.7 AND kinds <= 3 THEN 'facility' ELSE 'signal' END AS class FROM s"""
)
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("events"), (F.avg("l_quantity") / 25.5).alias("ratio"), F.max("l_discount").alias("facility_share"), F.count_distinct("l_returnflag").alias("facilities"))
    quiet = {"population": 1e6, "gap_years": 0, "all_cause_break": 1.0, "population_break": 1.0, "absorbed": 0.0, "absorbed_z": 0.0, "recording_ratio": 1.0}
    return it.triage(s.withColumns({k: F.lit(v) for k, v in quiet.items()} | {"off": F.col("events")})).select(F.col("l_suppkey").alias("id"), "class")


@query()
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("stratum"), F.col("s_acctbal").alias("x"))
    return it.corroborated(s, s.where("u % 5 = 0").select("u"), replicates=4999).select(r6("x"), r6("p"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n = 1")
def register_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return it.current(orders, id="o_custkey").select("o_custkey", "o_orderkey")


@query("SELECT l_suppkey AS id, round(-log10(greatest(p, 1e-300)) * abs(e) * (1 + t), 6) AS rank FROM (SELECT l_suppkey, exp(-count(*) / 100.0) AS p, avg(l_discount) AS e, max(l_linenumber) % 4 AS t FROM lineitem GROUP BY ALL)")
def lead_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.exp(-F.count("*") / 100.0).alias("p"), F.avg("l_discount").alias("e"), (F.max("l_linenumber") % 4).alias("t"))
    return s.select(F.col("l_suppkey").alias("id"), F.round(it.lead_rank(F.col("p"), F.col("e"), F.col("t")), 6).alias("rank"))


_STORY = """leads AS (SELECT event_id AS id, user_id AS place, ts::DATE - DATE '2024-01-01' AS first, ts::DATE - DATE '2024-01-01' + (event_id % 2) AS last FROM events WHERE event_type = 'error')"""


@query(
    f"""WITH {_STORY}, e AS (SELECT *, max(last) OVER (PARTITION BY place ORDER BY first, last, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM leads),
r AS (SELECT *, sum(CASE WHEN upto IS NULL OR first > upto THEN 1 ELSE 0 END) OVER (PARTITION BY place ORDER BY first, last, id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT id, min(id) OVER (PARTITION BY place, run) AS story FROM r"""
)
def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    leads = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("place"), day.alias("first"), (day + F.col("event_id") % 2).alias("last"))
    return it.stories(leads, graphs.components)


@query(
    """WITH c AS (SELECT c_nationkey AS u, c_mktsegment AS grp, count(*)::DOUBLE AS e, sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END)::DOUBLE AS o FROM customer GROUP BY ALL), n AS (SELECT grp, sum(o) / sum(e) AS rate FROM c GROUP BY ALL)
SELECT c.u, c.grp, c.o + r.o AS n, c.o AS k, round(c.e * n.rate / b.rate / (c.e * n.rate / b.rate + r.e), 6) AS p0 FROM c JOIN (SELECT * FROM c WHERE grp = 'BUILDING') r ON c.u = r.u JOIN n ON c.grp = n.grp, (SELECT rate FROM n WHERE grp = 'BUILDING') b WHERE c.grp <> 'BUILDING'"""
)
def disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("u"), F.col("c_mktsegment").alias("grp")).agg(F.count("*").cast("double").alias("e"), F.sum(F.when(F.col("c_acctbal") > 5000, 1).otherwise(0)).cast("double").alias("o"))
    return it.disparity(rows, reference="BUILDING").select("u", "grp", "n", "k", r6("p0"))


@query("SELECT c_custkey AS u, round((SELECT count(*) FROM customer b WHERE b.c_acctbal <= a.c_acctbal)::DOUBLE / (SELECT count(*) FROM customer), 6) AS percentile FROM customer a WHERE c_nationkey = 7")
def context_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"), F.col("c_acctbal").alias("value"), "c_nationkey")
    return it.context_percentiles(v, F.col("c_nationkey") == 7).select("u", r6("percentile"))


@query(f"WITH {EXPECTED}, f AS (SELECT DISTINCT u, year FROM expected WHERE y > 1.2 * mu), d AS (SELECT DISTINCT u, year FROM expected WHERE year % 2 = 0), b AS (SELECT count(*) AS m FROM f JOIN d USING (u, year)) SELECT round(m / ((SELECT count(*) FROM f) + (SELECT count(*) FROM d) - m), 6) AS jaccard, round(m / (SELECT count(*) FROM f), 6) AS precision, round(m / (SELECT count(*) FROM d), 6) AS recall FROM b")
def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = expected(spark, sf_dir)
    return it.recovery(e.where("y > 1.2 * mu"), e.where("year % 2 = 0")).select(r6("jaccard"), r6("precision"), r6("recall"))


@query(
    """WITH f AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS a, max((l_discount > 0.08)::INT) AS b, max((l_quantity > 40)::INT) AS c FROM lineitem GROUP BY ALL)
SELECT a, b, c, count(*)::BIGINT AS n FROM f WHERE a + b + c > 0 GROUP BY ALL"""
)
def capture_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pe.capture_patterns(_systems(spark, sf_dir), ["a", "b", "c"])


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as persons, and three systems that hold those with a line of some kind."""
    flags = {"a": F.col("l_returnflag") == "R", "b": F.col("l_discount") > 0.08, "c": F.col("l_quantity") > 40}
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.max(x.cast("int")).alias(k) for k, x in flags.items()])


@query()
def capture_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, sd = pe.multiple_systems(pe.capture_patterns(_systems(spark, sf_dir), ["a", "b", "c"]), ["a", "b", "c"])
    return spark.createDataFrame([(round(total, 3), round(sd, 3))], "total double, sd double")


@query()
def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = rows.groupBy(F.col("c_nationkey").alias("u"), (F.col("c_mktsegment") == "MACHINERY").cast("double").alias("machinery"), (F.col("o_orderpriority") == "5-LOW").cast("double").alias("low")).agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).cast("double").alias("y"), F.count("*").cast("double").alias("t"))
    return spark.createDataFrame(pe.cohort_fit(t, ["machinery", "low"]).round(6))


@query(
    """WITH RECURSIVE links AS (SELECT DISTINCT a.event_id AS l, b.event_id AS r FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.event_id - a.event_id < 60),
e AS (SELECT l AS a, r AS b FROM links UNION SELECT r, l FROM links), w AS (SELECT event_id AS id, event_id AS node FROM events UNION SELECT id, b FROM w JOIN e ON node = a) SELECT id, min(node) AS entity FROM w GROUP BY ALL"""
)
def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id")
    # events of a user under 60 ids apart: each with its next one, which links the same sets
    w = W.partitionBy("user_id").orderBy("id")
    pairs = ev.withColumn("r", F.lead("id").over(w)).where("r - id < 60").select(F.col("id").alias("l"), "r", F.lit(1.0).alias("p_match"))
    return pe.persons(ev, pairs)


@query(
    f"""WITH {REC}, t AS (SELECT facility_place, count(*) AS n FROM cells GROUP BY ALL), c AS (SELECT facility_place, n, sum(n) OVER (ORDER BY n DESC, facility_place ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS tot FROM t)
SELECT facility_place, n::BIGINT AS n, round(cum / tot, 6) AS share, cum - n < tot / 2 AS needed FROM c"""
)
def ranked_cum_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = governed(spark, sf_dir).groupBy("facility_place").agg(F.count("*").alias("n"))
    one = W.partitionBy(F.lit(0))
    cum = F.sum("n").over(one.orderBy(F.desc("n"), "facility_place").rowsBetween(W.unboundedPreceding, 0))
    rows = t.withColumns({"cum": cum, "tot": F.sum("n").over(one)})
    return rows.select("facility_place", "n", F.round(F.col("cum") / F.col("tot"), 6).alias("share"), (F.col("cum") - F.col("n") < F.col("tot") / 2).alias("needed"))


@query(f"WITH {REC} SELECT u, round(sum((n / t) * (n / t)), 6) AS hhi FROM (SELECT u, facility, count(*) AS n, sum(count(*)) OVER (PARTITION BY u) AS t FROM cells GROUP BY u, facility) GROUP BY ALL")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = governed(spark, sf_dir).groupBy("u", "facility").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("u"))
    return n.withColumn("s", share).groupBy("u").agg(F.round(F.sum(F.col("s") * F.col("s")), 6).alias("hhi"))


@query("SELECT o_orderstatus AS before, l_returnflag AS after, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def reclassification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_orderstatus").alias("before"), F.col("l_returnflag").alias("after")).agg(F.count("*").alias("n"))


@query("SELECT year(o_orderdate)::INT AS year, count(*)::BIGINT AS records, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS share FROM orders GROUP BY ALL")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("records"))
    return rows.select("year", "records", F.round(F.col("records") / F.sum("records").over(W.partitionBy(F.lit(0))), 6).alias("share"))


def _inputs(spark: SparkSession, sf_dir: str) -> study.Inputs:
    """What the questions read, all of it from one pass over the order lines: a joined line is written once, in narrow form."""
    from cellweave.sources.scratch import staged

    keep = ["u", "year", "month", "facility", "facility_place", "status", "age", "wt", F.col("reason").isNull().alias("governed")]
    every = staged(c.routed(records(spark, sf_dir), places(spark, sf_dir)).select(*keep), "study")
    rows = every.where("governed")
    shares = rows.groupBy("u", "year").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "R", 1)).alias("y"))
    national = shares.groupBy("year").agg((F.sum("y") / F.sum("n")).alias("share"))
    per = rows.groupBy("facility", "year").agg(F.count("*").alias("y"))
    total = per.agg(F.sum("y").alias("_all"))
    facilities = per.crossJoin(total).withColumn("mu", F.sum("y").over(W.partitionBy("facility")) * F.sum("y").over(W.partitionBy("year")) / F.col("_all"))  # one row
    months = rows.groupBy("u", "year", "month").agg(F.sum("wt").alias("y")).withColumn("mu", F.sum("y").over(W.partitionBy("u", "year")) / 12.0)
    both = staged(rows.groupBy("u", F.expr("cast(age div 10 as int)").alias("g")).agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum("wt"), F.lit(0)).alias("y")), "groups")
    groups = both.crossJoin(both.agg((F.sum("y") / F.sum("n")).alias("_r"))).withColumn("mu", F.col("n") * F.col("_r"))  # one row
    edges = staged(graphs.care_flow(every.groupBy(F.col("u").alias("a"), F.col("facility_place").alias("b")).agg(F.count("*").alias("n"))), "edges")
    # places in the order of their numbers, a step apart
    u = places(spark, sf_dir).select("u")
    distance = u.withColumn("d", F.explode(F.sequence(F.lit(-12), F.lit(12)))).select(F.col("u").alias("source"), (F.col("u") + F.col("d")).alias("u"), F.abs("d").cast("double").alias("d"))
    return study.Inputs(expected(spark, sf_dir, rows), edges=edges, shares=shares.join(national, "year"), facilities=facilities, groups=groups, months=months, distance=distance.join(u, "u"), train_last=1998)


@query()
def study_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study that asks all questions, with what is planted: three times the counts of nation 5 from 1999 on, and of nation 12 in 1997."""
    x = _inputs(spark, sf_dir)
    here = F.when((F.col("u") == 5) & (F.col("year") >= 1999), 3).when((F.col("u") == 12) & (F.col("year") == 1997), 3).otherwise(1)
    x.cells = x.cells.withColumn("y", F.col("y") * here)
    s = study.load({"study": "all order lines", "seeds": [""], "period": "1995..2001", "q": 0.1, "questions": tuple(study.METHODS)})
    return study.run(s, x).select("locus", "u", "first", "last", "question", "methods", r6("q"), r6("rank"))
