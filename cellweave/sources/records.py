"""Record tables: what a dataset's columns mean (roles), and the canonical record frame that all readers start from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Roles:
    """Which expression of a record table plays which part; analytics code knows roles only, never columns.

    ``missing`` gives, for a role, the values that declare it not recorded.
    """

    place: str
    when: str
    code: str
    sex: str | None = None
    age: str | None = None
    weight: str | None = None
    facility: str | None = None
    facility_place: str | None = None
    reported: str | None = None
    mark: str | None = None
    status: str | None = None
    missing: dict[str, tuple] = field(default_factory=dict)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order, customer, part and supplier: the record table of the registered queries.

    Fact tables meet by shuffled joins on their keys; which side is small enough to be sent whole is left to Spark's
    own size check. Orders meet their customers before the lines do, so that lines aren't shuffled for these.
    """
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))


#: The roles of order lines: customers' nations are places, the part's type and brand the code.
ORDER_LINES = Roles(
    place="c_nationkey",
    when="o_orderdate",
    code="concat(p_type, '|', p_brand)",
    sex="l_linestatus",
    age="p_size",
    weight="cast(l_quantity as bigint)",
    facility="l_suppkey",
    facility_place="s_nationkey",
    reported="l_shipdate",
    mark="l_extendedprice",
    status="l_returnflag",
    missing={"age": (50,), "sex": (), "code": ("PROMO|Brand#7",)},
)


def canonical(records: DataFrame, roles: Roles, *, cap: int = 80, sexes: dict | None = None) -> DataFrame:
    """(u, year, month, sex, age, code, wt and the other roles): one row per record, missing never turned into a value.

    Ages are whole years up to ``cap``; a missing age stays missing (``least`` would skip it).
    """
    sexes = sexes or {"F": 1, "O": 2}
    e = F.expr

    def declared(role: str, x: Column) -> Column:
        values = roles.missing.get(role, ())
        return F.when(x.isin(*values), F.lit(None)).otherwise(x) if values else x

    sex = F.lit(None).cast("int")
    if roles.sex:
        for label, code in sexes.items():
            sex = F.when(e(roles.sex) == label, code).otherwise(sex)
    age = declared("age", e(roles.age)) if roles.age else F.lit(0)
    age = F.when(age.isNull(), None).otherwise(F.least(F.floor(age), F.lit(cap)))
    columns = {
        "u": e(roles.place).cast("int"),
        "date": e(roles.when).cast("date"),
        "year": F.year(e(roles.when)),
        "month": F.month(e(roles.when)),
        "sex": sex,
        "age": age.cast("int"),
        "code": F.when(F.trim(declared("code", e(roles.code))) == "", None).otherwise(declared("code", e(roles.code))),
        "wt": (e(roles.weight) if roles.weight else F.lit(1)).cast("long"),
    }
    for role in ("facility", "facility_place", "reported", "mark", "status"):
        if getattr(roles, role):
            columns[role] = e(getattr(roles, role))
    return records.select(*[c.alias(n) for n, c in columns.items()])
