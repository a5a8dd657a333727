"""What registered queries share: the record frame, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.sources.records import ORDER_LINES, canonical, order_lines, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The canonical records of order lines; the nations of region 4 are no known places.
REC = """rec AS (SELECT c_nationkey AS u, o_orderdate::DATE AS date, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month,
  CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS sex, CASE WHEN p_size IN (50) THEN NULL ELSE least(p_size, 80) END AS age,
  CASE WHEN concat(p_type, '|', p_brand) IN ('PROMO|Brand#7') THEN NULL ELSE concat(p_type, '|', p_brand) END AS code, l_quantity::BIGINT AS wt,
  l_suppkey AS facility, s_nationkey AS facility_place, l_shipdate AS reported, l_extendedprice AS mark, l_returnflag AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
places AS (SELECT n_nationkey AS u, n_regionkey AS region FROM nation WHERE n_regionkey <> 4),
routed AS (SELECT rec.*, CASE WHEN places.u IS NULL THEN 'municipality' WHEN sex IS NULL THEN 'sex' WHEN age IS NULL OR age < 0 THEN 'age' WHEN code IS NULL OR code = '' THEN 'code' END AS reason
  FROM rec LEFT JOIN places ON rec.u = places.u),
cells AS (SELECT * FROM routed WHERE reason IS NULL)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(order_lines(spark, sf_dir), ORDER_LINES)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("region"))


def governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that have a cell."""
    from cellweave.operators.counts import routed

    return routed(records(spark, sf_dir), places(spark, sf_dir)).where("reason is null")


#: Yearly counts and expectations of places: expected at all places' rate per customer in each year, phi by moments.
EXPECTED = REC + """,
yearly AS (SELECT u, year, sum(wt)::BIGINT AS y FROM cells GROUP BY ALL),
people AS (SELECT c_nationkey AS u, count(*)::DOUBLE AS n FROM customer GROUP BY ALL),
grid AS (SELECT p.u, t.year, n FROM people p JOIN places USING (u), (SELECT DISTINCT year FROM cells) t),
filled AS (SELECT grid.u, grid.year, n, coalesce(y, 0)::BIGINT AS y FROM grid LEFT JOIN yearly ON grid.u = yearly.u AND grid.year = yearly.year),
level AS (SELECT *, n * sum(y) OVER (PARTITION BY year) / sum(n) OVER (PARTITION BY year) AS mu FROM filled),
spread AS (SELECT CASE WHEN sum((y - mu) * (y - mu) - mu) > 0 THEN greatest(sum(mu * mu) / sum((y - mu) * (y - mu) - mu), 0.01) ELSE 1e9 END AS phi FROM level),
expected AS (SELECT level.*, phi FROM level, spread)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("u")).agg(F.count("*").cast("double").alias("n"))


def expected(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    """(u, year, n, y, mu, phi), written once: whatever refers to it several times reads the records once.

    ``cells``: the records that have a cell, where they are at hand already.
    """
    from pyspark.sql import Window as W

    from cellweave.operators.expectation import dispersion
    from cellweave.operators.exposure import lattice
    from cellweave.sources.scratch import staged

    cells = governed(spark, sf_dir) if cells is None else cells
    yearly = cells.groupBy("u", "year").agg(F.sum("wt").alias("y"))
    grid = lattice(places(spark, sf_dir).select("u"), cells.select("year")).join(people(spark, sf_dir), "u")
    filled = grid.join(yearly, ["u", "year"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    w = W.partitionBy("year")
    level = staged(filled.withColumn("mu", F.col("n") * F.sum("y").over(w) / F.sum("n").over(w)), "expected")
    return level.crossJoin(dispersion(level))  # one row
