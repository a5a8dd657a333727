"""Ranks and running sums over a whole table in a total order, without one task that holds it.

Spark range-sorts the rows; the part in which a row stands is written down with it. Sums of the parts (a row each) give
what comes before a part, windows within parts the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.sources.scratch import staged


def in_parts(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``_part``: parts follow one another in ``order``, ties of the whole order stand anywhere."""
    dealt = rows.repartitionByRange(*order)
    return staged(dealt.withColumn("_part", F.spark_partition_id()), "ordered")


def running(rows: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums, each row's own value included. A row number is the sum of 1."""
    parts = in_parts(rows.withColumns({f"_v_{k}": v for k, v in sums.items()}), order)
    per = parts.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    before = per.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums])
    upto = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = parts.join(F.broadcast(before), "_part")  # as many rows as parts
    out = out.withColumns({k: F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(upto) for k in sums})
    return out.drop("_part", *[f"_{x}_{k}" for k in sums for x in "vb"])


def least_from(rows: DataFrame, order: list, name: str, value: Column) -> DataFrame:
    """``rows`` with the least ``value`` of each row and all after it."""
    parts = in_parts(rows.withColumn("_v", value), order)
    later = W.orderBy("_part").rowsBetween(1, W.unboundedFollowing)  # a row a part
    after = parts.groupBy("_part").agg(F.min("_v").alias("_m")).select("_part", F.min("_m").over(later).alias("_after"))
    # backwards from the end: Spark goes through the rest of a part anew for each row of a frame that ends with it
    own = W.partitionBy("_part").orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
    out = parts.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    out = out.join(F.broadcast(after), "_part").withColumn(name, F.least(F.min("_v").over(own), F.col("_after")))
    return out.drop("_part", "_v", "_after", "_k")


def share_not_above(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``percentile``: the share of rows whose value isn't above the row's."""
    counts = running(rows.groupBy(value).agg(F.count("*").alias("_n")), [value], {"_upto": F.col("_n")})
    total = counts.agg(F.sum("_n").alias("_all"))
    share = counts.crossJoin(total).select(value, (F.col("_upto") / F.col("_all")).alias("percentile"))  # total is one row
    return rows.join(share, value)
