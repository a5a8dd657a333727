from __future__ import annotations

import datetime as dt

import pytest

from cellweave.plans import declare as de
from cellweave.sources.records import ORDER_LINES, Roles, order_lines
from conftest import SF


def test_fields_and_supports():
    a = de.Field.parse("lines:order:type:PROMO", kind="share", support="region")
    assert a.law == "ratio_of_sums" and a.name == "lines:order:type:PROMO"
    assert de.common_support(a, de.Field.parse("x:y:z:w")) == "region"
    with pytest.raises(ValueError):
        de.Field.parse("a:b:c")


def test_what_roles_allow(spark):
    assert de.declared(ORDER_LINES)["flow"] == "away_counts"
    assert de.declared(Roles(place="p", when="d", code="c"))["measure"] == "no mark is declared"
    read = dict(de.coverage(order_lines(spark, SF), ORDER_LINES))
    assert read["p_brand"] == "code" and read["l_tax"] == "nothing reads it" and len(read) == len(order_lines(spark, SF).columns)


def test_offers(spark):
    got = de.offers(order_lines(spark, SF), ORDER_LINES, values={"l_returnflag": ["R"]}, classifiers=("p_name",), groups={"codes": ("p_type", "p_brand")}, links=("o_orderkey",))
    assert de.Offer("share", "l_returnflag", "R") in got and de.Offer("measure", "l_tax") in got and de.Offer("flow", "s_nationkey") in got
    assert de.Offer("measure", "p_size") not in got and de.Offer("mention", "p_brand", "codes") in got and de.Offer("link", "o_orderkey") in got


def test_grammars(spark):
    assert de.base_and_modifiers("census+kappa+share") == ("census", ["kappa", "share"])
    for wrong in ("+kappa", "census+", "a++b", ""):
        with pytest.raises(ValueError):
            de.base_and_modifiers(wrong)
    assert de.band_edges(["0-4", "5-14", "15+"]) == [0, 5, 15]
    for wrong in (["0-4", "6+"], ["0-4"], ["x"]):
        with pytest.raises(ValueError):
            de.band_edges(wrong)
    assert de.exposure_source(ORDER_LINES, (1996, 1999), {"early": (1990, 1997, True), "crude": (1990, 2010, False), "full": (1990, 2010, True)}) == "full"
    df = spark.createDataFrame([(1, "A", "Q02Q690"), (2, "B", "B17"), (3, None, None)], "id int, s string, codes string")
    assert [r.id for r in df.where(de.outcome("s=A,C")).collect()] == [1]
    assert [r.id for r in df.where(de.outcome("codes~Q69,B1")).collect()] == [1, 2]
    with pytest.raises(ValueError):
        de.outcome("s>3")
    codes = spark.createDataFrame([(c,) for c in ("A00", "A09", "A091", "A10", "B20")], "code string")
    assert [r.code for r in de.code_range(codes, "A01", "A09").orderBy("code").collect()] == ["A09", "A091"]
    days = spark.createDataFrame([(dt.date(2020, 1, 5), dt.date(2020, 1, 1))] * 3, "a date, b date")
    assert de.interval_sign(days, "a", "b") == -1 and de.interval_sign(days, "b", "a") == 1
