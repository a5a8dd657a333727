"""Restrictions of codes, reserved periods, series of groups."""

from __future__ import annotations

import pytest

from cellweave.operators import admissible as ad


def test_restrictions_and_reasons(spark):
    kinds = "code string, sex string, edit_sex string, sex_edit string, age_from int, age_to int, age_edit string, underlying boolean"
    a = [("m", "M", None, None, None, None, None, True), ("f", None, "F", "absolute", None, None, None, True), ("soft", None, "F", "conditional", 10, 20, "conditional", True)]
    a += [("old", None, None, None, 65, None, "absolute", True), ("mid", None, None, None, 15, 30, "absolute", None), ("never", None, None, None, None, None, None, False), ("whole", None, None, None, 0, None, "absolute", True)]
    edges = [0, 10, 20, 60]
    rules = ad.restrictions(spark.createDataFrame(a, kinds), edges)
    assert {r.code: (r.sex, r.low, r.high, r.never) for r in rules.collect()} == {"m": (1, None, None, False), "f": (2, None, None, False), "old": (None, 3, 3, False), "mid": (None, 1, 2, False), "never": (None, None, None, True)}
    rec = [("m", 1, 5, None), ("m", 2, 5, None), ("f", 1, 5, None), ("soft", 1, 50, None), ("old", 1, 59, None), ("old", 1, 60, None), ("mid", 2, 9, None), ("mid", 2, 10, None), ("mid", 2, 59, None), ("mid", 2, 60, None), ("never", 1, 1, None), ("m", 2, 5, "age"), (None, 1, 1, "code")]
    out = ad.possible(spark.createDataFrame([(i, *r) for i, r in enumerate(rec)], "i int, code string, sex int, age int, reason string"), rules, edges)
    got = {r.i: r.reason for r in out.collect()}
    assert [got[i] for i in range(len(rec))] == [None, "impossible", "impossible", None, "impossible", None, "impossible", None, None, "impossible", "cause", "age", "code"]


def test_reserve(spark):
    held, cells = {"deaths": {2023, 2024}}, spark.createDataFrame([(2022,), (2023,)], "year int")
    with pytest.raises(ad.ReservedPeriod, match="2023"):
        ad.unreserved(cells, "deaths", held)
    assert ad.unreserved(cells.where("year = 2022"), "deaths", held).count() == 1
    assert ad.unreserved(cells, "births", held).count() == 2
    with ad.reserve_open():
        assert ad.unreserved(cells, "deaths", held).count() == 2
    with pytest.raises(ad.ReservedPeriod):
        ad.check_reserved("deaths", [2024], held)
