"""What may be counted where, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.operators import admissible as ad
from cellweave.operators.counts import routed
from cellweave.queries.base import REC, places, query, records
from cellweave.sources.records import table

EDGES = [0, 10, 20, 30, 40]
_RULES = """x AS (SELECT DISTINCT concat(p_type, '|', p_brand) AS code, p_type FROM part), rules AS (SELECT code, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 END AS sex, p_type = 'ECONOMY' AS aged, p_type = 'LARGE' AND code LIKE '%#3' AS never FROM x)"""


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restrictions by rule of part types: promo one sex, small the other (by an edit), economy from 12 to under 30, one code no cause."""
    x = table(spark, sf_dir, "part").select(F.concat_ws("|", "p_type", "p_brand").alias("code"), "p_type").distinct()
    is_ = lambda t: F.col("p_type") == t
    return x.select(
        "code",
        F.when(is_("PROMO"), "M").alias("sex"),
        F.when(is_("SMALL"), "F").alias("edit_sex"),
        F.when(is_("SMALL"), "absolute").when(is_("MEDIUM"), "conditional").alias("sex_edit"),
        F.when(is_("ECONOMY"), 12).alias("age_from"),
        F.when(is_("ECONOMY"), 30).alias("age_to"),
        F.when(is_("ECONOMY"), "absolute").alias("age_edit"),
        (~(is_("LARGE") & F.col("code").endswith("#3"))).alias("underlying"),
    )


@query(
    f"""WITH {REC}, {_RULES}, r AS (SELECT coalesce(reason, CASE WHEN never THEN 'cause' WHEN rules.sex <> routed.sex OR aged AND (age < 10 OR age >= 30) THEN 'impossible' END) AS reason, wt FROM routed LEFT JOIN rules USING (code))
SELECT coalesce(reason, 'counted') AS reason, sum(wt)::BIGINT AS y FROM r GROUP BY ALL"""
)
def impossible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's weight, counted or by the reason why not, cells that a code excludes among them."""
    rows = routed(records(spark, sf_dir), places(spark, sf_dir))
    rows = ad.possible(rows, ad.restrictions(_attributes(spark, sf_dir), EDGES), EDGES)
    return rows.groupBy(F.coalesce("reason", F.lit("counted")).alias("reason")).agg(F.sum("wt").alias("y"))


@query(
    f"""WITH {REC}, n AS (SELECT u, sex * 10 + age // 20 AS s, count(*)::DOUBLE AS n FROM cells GROUP BY ALL), y AS (SELECT u, year, sex * 10 + age // 20 AS s, sum(wt) AS y FROM cells GROUP BY ALL),
g AS (SELECT n.u, n.s, t.year, n, coalesce(y, 0) AS y FROM n, (SELECT DISTINCT year FROM cells) t LEFT JOIN y ON y.u = n.u AND y.s = n.s AND y.year = t.year),
e AS (SELECT *, n * sum(y) OVER w / sum(n) OVER w AS e FROM g WINDOW w AS (PARTITION BY year, s))
SELECT region AS grp, year, sum(y)::BIGINT AS observed, round(sum(e), 4) AS expected FROM e JOIN places USING (u) WHERE region <> 3 GROUP BY ALL"""
)
def group_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and expected counts of regions by year, at all places' rates by sex and age; region 3 is no group."""
    from cellweave.queries.modelling import _grid

    cells = _grid(spark, sf_dir).withColumnRenamed("g", "stratum")
    groups = places(spark, sf_dir).where("region <> 3").select("u", F.col("region").alias("grp"))
    return ad.group_series(cells, groups).select("grp", "year", F.col("observed").cast("bigint").alias("observed"), F.round("expected", 4).alias("expected"))
