"""Counts, marks, shares, flows, delays, links and exposures over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.functions import cells as fc
from cellweave.operators import counts as c, exposure as x
from cellweave.queries.base import EXPECTED, REC, governed, people, places, query, records
from cellweave.sources.records import table

r6 = lambda col, name=None: F.round(col, 6).alias(name or col)


@query(f"WITH {REC} SELECT u, year, sex, age, code, sum(wt)::BIGINT AS y FROM cells GROUP BY ALL")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.event_counts(records(spark, sf_dir), places(spark, sf_dir)).counts


@query(f"WITH {REC} SELECT year, reason, code, sum(wt)::BIGINT AS y FROM routed WHERE reason IS NOT NULL GROUP BY ALL")
def unallocated_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.event_counts(records(spark, sf_dir), places(spark, sf_dir)).unallocated


@query(f"WITH {REC} SELECT year, sum(wt)::BIGINT AS records, sum(CASE WHEN reason IS NULL THEN wt ELSE 0 END)::BIGINT AS counted, sum(CASE WHEN reason IS NOT NULL THEN wt ELSE 0 END)::BIGINT AS left_out FROM routed GROUP BY ALL")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.routed(records(spark, sf_dir), places(spark, sf_dir))
    counted = F.sum(F.when(F.col("reason").isNull(), F.col("wt")).otherwise(0))
    left = F.sum(F.when(F.col("reason").isNotNull(), F.col("wt")).otherwise(0))
    return rows.groupBy("year").agg(F.sum("wt").alias("records"), counted.alias("counted"), left.alias("left_out"))


@query(f"WITH {REC} SELECT u, year, month, sex, age, code, sum(wt)::BIGINT AS y FROM cells GROUP BY ALL")
def monthly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.event_counts(records(spark, sf_dir), places(spark, sf_dir), by=("month",)).counts


_SUNDAY = "({d} - dayofweek({d})::INT)"
_WEEK = f"""weeks AS (SELECT *, ({_SUNDAY.format(d="date")} + 3) AS mid, {_SUNDAY.format(d="date")} AS sunday FROM days),
epi AS (SELECT *, year(mid)::INT AS epi_year, (({{sunday}} - ((make_date(year(mid)::INT, 1, 4)) - dayofweek(make_date(year(mid)::INT, 1, 4))::INT)) // 7 + 1)::INT AS week FROM weeks)""".replace("{sunday}", "sunday")


@query(f"WITH days AS (SELECT *, ts::DATE AS date FROM events), {_WEEK} SELECT event_type, epi_year, week, count(*)::BIGINT AS y FROM epi GROUP BY ALL")
def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, w = fc.epi_week(F.to_date("ts"))
    return table(spark, sf_dir, "events").groupBy("event_type", y.alias("epi_year"), w.alias("week")).agg(F.count("*").alias("y"))


@query(f"WITH {REC} SELECT u, year, CASE WHEN status = 'N' THEN NULL ELSE status END AS value, sum(wt)::BIGINT AS n FROM cells GROUP BY ALL")
def composition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.composition(governed(spark, sf_dir), "status", missing=("N",))


@query(f"WITH {REC} SELECT u, year, sum(wt)::BIGINT AS n, sum(CASE WHEN status = 'R' THEN wt ELSE 0 END)::BIGINT AS k FROM cells WHERE status <> 'N' GROUP BY ALL")
def share_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.shares(governed(spark, sf_dir), "status", ("R",), missing=("N",))


@query(f"WITH {REC} SELECT u, year, sum(wt)::BIGINT AS n, sum(CASE WHEN status = 'N' THEN wt ELSE 0 END)::BIGINT AS k FROM cells GROUP BY ALL")
def quality_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.shares(governed(spark, sf_dir), "status", (), missing=("N",), quality=True)


@query(f"WITH {REC} SELECT facility, u, code, sum(wt)::BIGINT AS n, sum(CASE WHEN status = 'R' THEN wt ELSE 0 END)::BIGINT AS k FROM cells WHERE status <> 'N' GROUP BY ALL")
def composition_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.shares(governed(spark, sf_dir), "status", ("R",), missing=("N",), keys=("facility", "u", "code"))


@query(f"WITH {REC} SELECT u, year, sum(wt)::BIGINT AS n, sum(CASE WHEN facility_place <> u THEN wt ELSE 0 END)::BIGINT AS k FROM cells GROUP BY ALL")
def away_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.away(governed(spark, sf_dir), "facility_place")


_MARKS = REC + """, marked AS (SELECT *, CASE WHEN mark IS NULL THEN 'mark missing' WHEN mark < 2000 OR mark > 95000 THEN 'mark out of bounds' END AS mark_reason, CASE WHEN mark > 0 THEN ln(mark) END AS lm FROM cells)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.marks(governed(spark, sf_dir), low=2000, high=95000)


@query(f"WITH {_MARKS} SELECT u, year, code, count(*)::BIGINT AS n, round(sum(mark), 4) AS s1, round(sum(lm), 6) AS l1, round(sum(lm * lm), 6) AS l2 FROM marked WHERE mark_reason IS NULL GROUP BY ALL")
def mark_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = c.mark_moments(_marked(spark, sf_dir), keys=("u", "year", "code"))
    return m.select("u", "year", "code", "n", F.round("s1", 4).alias("s1"), r6("l1"), r6("l2"))


@query(f"WITH {_MARKS} SELECT year, mark_reason, count(*)::BIGINT AS n FROM marked WHERE mark_reason IS NOT NULL GROUP BY ALL")
def mark_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("mark_reason is not null").groupBy("year", "mark_reason").agg(F.count("*").alias("n"))


@query(f"WITH {_MARKS} SELECT u, grouping(u)::INT AS total, count(*)::BIGINT AS n, round(quantile_cont(mark, 0.5), 6) AS q50, round(quantile_cont(mark, 0.9), 6) AS q90 FROM marked WHERE mark_reason IS NULL GROUP BY ROLLUP (u)")
def mark_quantiles_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = c.mark_quantiles(_marked(spark, sf_dir), "u")
    return q.select("u", "total", "n", r6("q50"), r6("q90"))


@query(
    f"""WITH {_MARKS}, g AS (SELECT *, code AS stratum, CASE WHEN facility_place = u THEN '' ELSE status END AS pg FROM marked WHERE mark_reason IS NULL),
b AS (SELECT stratum, avg(lm) AS base FROM g GROUP BY ALL),
o AS (SELECT g.stratum, pg, sum(lm - base) / (count(*) + 10) AS off FROM g JOIN b ON g.stratum = b.stratum WHERE pg <> '' GROUP BY ALL)
SELECT u, year, count(*)::BIGINT AS n, round(sum(lm - coalesce(off, 0)), 5) AS l1 FROM g LEFT JOIN o ON g.stratum = o.stratum AND g.pg = o.pg GROUP BY ALL"""
)
def casemix_adjusted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir).where("mark_reason is null").withColumn("pg", F.when(F.col("facility_place") == F.col("u"), "").otherwise(F.col("status")))
    adjusted = c.casemix_adjusted(rows, "code", "pg")
    return adjusted.groupBy("u", "year").agg(F.count("*").alias("n"), F.round(F.sum("adjusted"), 5).alias("l1"))


@query("SELECT source, category, count(*)::BIGINT AS y FROM (SELECT source, unnest(list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda t: t[1:3]))) AS category FROM documents) GROUP BY ALL")
def code_list_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.exploded_codes(table(spark, sf_dir, "documents"), fc.categories(F.lower("text"), "[a-z]{3,}"), keys=("source",))


@query(
    """WITH e AS (SELECT DISTINCT o_custkey AS id, c_nationkey AS stratum, p_type AS category FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
p AS (SELECT id, stratum, max((category = 'PROMO')::INT) AS has FROM e GROUP BY ALL), t AS (SELECT stratum, count(*)::BIGINT AS n, sum(has)::BIGINT AS n_seed FROM p GROUP BY ALL)
SELECT e.stratum, category, count(*)::BIGINT AS n_code, sum(has)::BIGINT AS n_both, any_value(t.n) AS n, any_value(n_seed) AS n_seed FROM e JOIN p ON e.id = p.id AND e.stratum = p.stratum JOIN t ON e.stratum = t.stratum WHERE category <> 'PROMO' GROUP BY ALL"""
)
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("o_custkey").alias("id"), F.col("c_nationkey").alias("stratum"), F.col("p_type").alias("category"))
    return c.cooccurrence(rows, id="id", category="category", stratum="stratum", seed="PROMO").select("stratum", "category", "n_code", "n_both", "n", "n_seed")


_DELAY = REC + f", days AS (SELECT u, date, reported::DATE AS rep FROM rec), {_WEEK}, late AS (SELECT *, date_diff('day', date, rep) AS d FROM epi)"


@query(f"WITH {_DELAY} SELECT u, epi_year, week, (d // 7)::INT AS delay, count(*)::BIGINT AS n FROM late WHERE u IS NOT NULL AND d >= 0 GROUP BY ALL")
def delay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.delays(records(spark, sf_dir), "date", "reported")[0].withColumn("delay", F.col("delay").cast("int"))


@query(f"WITH {_DELAY} SELECT epi_year, count(*)::BIGINT AS left_out FROM late WHERE NOT coalesce(u IS NOT NULL AND d >= 0, false) GROUP BY ALL")
def delays_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.delays(records(spark, sf_dir), "date", "reported")[1]


_LINK = """pairs AS (SELECT doc_id AS l, CASE WHEN quality = 1 THEN 0.9 ELSE 0.4 END AS p_match FROM labels UNION ALL SELECT doc_id, 0.5 FROM labels WHERE toxic = 1),
best AS (SELECT l, max(p_match) AS p FROM pairs GROUP BY ALL),
linked AS (SELECT source, lang, count(*)::BIGINT AS n, round(sum(coalesce(p, 0)), 6) AS k, round(sum(coalesce(p, 0) * (1 - coalesce(p, 0))), 6) AS kv FROM documents LEFT JOIN best ON doc_id = l GROUP BY ALL)"""


def _linked(spark: SparkSession, sf_dir: str, keys: tuple[str, ...]) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    one = labels.select(F.col("doc_id").alias("l"), F.when(F.col("quality") == 1, 0.9).otherwise(0.4).alias("p_match"))
    pairs = one.union(labels.where("toxic = 1").select("doc_id", F.lit(0.5)))
    return c.linked(table(spark, sf_dir, "documents").select("doc_id", *keys), pairs, id="doc_id", keys=keys)


@query(f"WITH {_LINK} SELECT * FROM linked")
def linked_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir, ("source", "lang")).select("source", "lang", "n", r6("k"), r6("kv"))


@query(
    f"""WITH {_LINK}, s AS (SELECT source, sum(n) AS n, sum(k) AS k FROM linked GROUP BY ALL), c AS (SELECT sum(k) / sum(n) AS c FROM s),
t AS (SELECT greatest((sum(n * (k / n - c) * (k / n - c)) - sum(n * c * (1 - c) / n)) / sum(n), 1e-6) AS tau2 FROM s, c)
SELECT source, round((k + greatest(c * (1 - c) / tau2 - 1, 0) * c) / (n + greatest(c * (1 - c) / tau2 - 1, 0)), 6) AS completeness FROM s, c, t"""
)
def link_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.link_completeness(_linked(spark, sf_dir, ("source",)).select("source", "n", r6("k"))).select("source", r6("completeness"))


@query(f"WITH {REC} SELECT u, facility, facility_place, code, year, sum(wt)::BIGINT AS y FROM cells GROUP BY ALL")
def facility_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.facility_cube(governed(spark, sf_dir))


@query("SELECT conv_id, turn, CASE WHEN role IS NULL THEN turn ELSE min(turn) OVER (PARTITION BY role, conv_id) END AS rep FROM conversations")
def group_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("g", F.when(F.col("role").isNotNull(), F.concat_ws(":", "conv_id", "role")))
    return c.representative(rows, "g", "turn").select("conv_id", "turn", "rep")


_POP = """ev AS (SELECT c_nationkey AS u, year(o_orderdate)::INT AS year, count(*)::BIGINT AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
pop AS (SELECT n.u, t.year, coalesce(ev.y, 0)::DOUBLE AS n FROM (SELECT n_nationkey AS u FROM nation) n CROSS JOIN (SELECT DISTINCT year + 1 AS year FROM ev) t LEFT JOIN ev ON ev.u = n.u AND ev.year = t.year - 1)"""


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    ev = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("u"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("y"))
    return x.events_population(ev, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("u")), ev.select((F.col("year") + 1).alias("year")), lag=1)


@query(f"WITH {_POP} SELECT * FROM pop")
def events_population_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _population(spark, sf_dir)


_KAPPA = "kappa AS (SELECT n_nationkey AS u, 0.5 + 0.1 * n_regionkey AS k, 0.05 * (n_regionkey + 1) AS ks FROM nation WHERE n_regionkey < 4)"


@query(f"WITH {_POP}, {_KAPPA} SELECT pop.u, year, round(n * k, 6) AS n, round(sqrt(0.01 + ks * ks), 6) AS s FROM pop JOIN kappa ON pop.u = kappa.u")
def exposure_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 4")
    kappa = nation.select(F.col("n_nationkey").alias("u"), (0.5 + 0.1 * F.col("n_regionkey")).alias("k"), (0.05 * (F.col("n_regionkey") + 1)).alias("ks"))
    out = x.modified(_population(spark, sf_dir).withColumn("s", F.lit(0.1)), kappa, on=["u"], factor="k", sd="ks")
    return out.select("u", "year", r6("n"), r6("s"))


_CONF = "conf AS (SELECT a.n_regionkey AS k, b.n_regionkey AS j, -1 AS sex, CASE WHEN a.n_regionkey = b.n_regionkey THEN 0.9 ELSE 0.05 END AS c, 1.0 AS r FROM (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey < 3) a, (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey < 3) b)"


@query(
    f"""WITH {_CONF}, base AS (SELECT c_nationkey AS u, 2020 AS year, 1 AS sex, (c_custkey % 5)::INT AS g, count(*)::DOUBLE AS n FROM customer GROUP BY ALL),
mix AS (SELECT u, year, base.sex, k AS g, sum(c * r * n) AS n FROM base JOIN conf ON base.g = conf.j GROUP BY ALL)
SELECT u, year, sex, g, round(n, 6) AS n FROM mix UNION ALL SELECT u, year, sex, g, round(n, 6) FROM base WHERE g NOT IN (SELECT k FROM conf)"""
)
def recorded_exposure_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_regionkey").distinct()
    a, b = regions.withColumnRenamed("n_regionkey", "k"), regions.withColumnRenamed("n_regionkey", "j")
    confusion = a.crossJoin(b).select("k", "j", F.lit(-1).alias("sex"), F.when(F.col("k") == F.col("j"), 0.9).otherwise(0.05).alias("c"), F.lit(1.0).alias("r"))  # a few groups
    base = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("u"), F.lit(2020).alias("year"), F.lit(1).alias("sex"), (F.col("c_custkey") % 5).cast("int").alias("g")).agg(F.count("*").cast("double").alias("n"))
    return x.recorded(base, confusion).select("u", "year", "sex", "g", r6("n"))


@query("SELECT c_nationkey AS u, 2020 AS year, 1 AS sex, (p_size // 5)::INT AS band, sum(n)::BIGINT AS n, round(sum(sd) / sum(n), 6) AS s FROM (SELECT c_nationkey, p_size, count(*) AS n, sqrt(count(*)) AS sd FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY ALL")
def band_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    single = rows.groupBy(F.col("c_nationkey").alias("u"), F.lit(2020).alias("year"), F.lit(1).alias("sex"), "p_size").agg(F.count("*").alias("n"), F.sqrt(F.count("*")).alias("sd"))
    return x.banded(single, fc.band(F.col("p_size"), tuple(range(0, 55, 5)))).select("u", "year", "sex", "band", "n", r6("s"))


@query("WITH y AS (SELECT c_nationkey AS u, year(o_orderdate)::INT AS year, count(*) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT n_regionkey AS unit, year, sum(y)::BIGINT AS y FROM y JOIN nation ON u = n_nationkey GROUP BY ALL")
def lift_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = orders.groupBy(F.col("c_nationkey").alias("u"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("y"))
    return x.lift("sum")(per, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("unit")))


@query(f"WITH {EXPECTED} SELECT region AS unit, year, round(sum(y) / sum(n), 6) AS value FROM filled JOIN places ON filled.u = places.u GROUP BY ALL")
def lift_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.queries.base import expected

    units = places(spark, sf_dir).withColumnRenamed("region", "unit")
    return x.lift("ratio_of_sums")(expected(spark, sf_dir).select("u", "year", "y", "n"), units).select("unit", "year", r6("value"))


@query("SELECT c_nationkey AS u, 0 AS year, round(sum(c_acctbal * w) / sum(w), 6) AS value, round(1 / sum(w), 9) AS variance FROM (SELECT c_nationkey, c_acctbal, 1.0 + c_custkey % 3 AS w FROM customer) GROUP BY ALL")
def lift_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"), F.lit(0).alias("year"), F.col("c_acctbal").alias("value"), (1.0 + F.col("c_custkey") % 3).alias("w"), F.col("c_nationkey").alias("nation"))
    out = x.lift("weighted_mean")(v.drop("nation"), v.select("u", F.col("nation").alias("unit")))
    return out.select(F.col("unit").alias("u"), "year", r6("value"), F.round("variance", 9).alias("variance"))


@query("SELECT place, round(sum(n), 4) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS place, p_retailprice / len(string_split(p_name, ' ')) AS n FROM part) GROUP BY ALL")
def pooled_places_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("place"), F.col("p_retailprice").alias("n"))
    return x.split_pooled(rows, "place", sign=" ").groupBy("place").agg(F.round(F.sum("n"), 4).alias("n"))


@query("SELECT c_nationkey AS u, round(sum(c_acctbal), 4) AS value FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY ALL")
def context_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "MACHINERY").groupBy(F.col("c_nationkey").alias("u")).agg(F.round(F.sum("c_acctbal"), 4).alias("value"))


@query("SELECT event_type, count(*)::BIGINT AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS harmed FROM events GROUP BY ALL")
def context_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("harmed"))


@query("SELECT o_custkey, count(*)::BIGINT AS n, max((l_returnflag = 'R')::INT) AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def cohort_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def person_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT source, lang, count(*)::BIGINT AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL")
def records_without_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("source", "lang").agg(F.count("*").alias("n"))
